"""The same results in plain SQL, for DuckDB.

Detection is written out relationally here: candidate spans per rule, then
validation, keyword windows, overlap and location as ordinary queries.
Offsets are bytes, so the text is first turned into a string with one
character per byte: chr(2) for the first byte of a non-ASCII character and
chr(1) for the others.
"""

from veilscan.functions.scalars import REDACTED
from veilscan.operators.detectors import DEFAULT, DEFAULT_DETECTORS, PLAIN_CATEGORIES

_NAMES = ("low", "medium", "high")


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def byte_view(text: str) -> str:
    out = f"replace(replace({text}, chr(1), chr(4)), chr(2), chr(4))"
    for low, high, extra in (("10000", "10FFFF", 3), ("800", "FFFF", 2), ("80", "7FF", 1)):
        out = f"regexp_replace({out}, '[\\x{{{low}}}-\\x{{{high}}}]', chr(2) || repeat(chr(1), {extra}), 'g')"
    return out


def _digit_list(d: str) -> str:
    return f"list_transform(string_split({d}, ''), lambda c: cast(c as int))"


def luhn(d: str) -> str:
    """``d`` is a string of digits."""
    return (
        f"(list_sum(list_transform(range(1, len({d}) + 1), lambda i: case when (len({d}) - i) % 2 = 1 then "
        f"case when 2 * cast(substr({d}, i, 1) as int) > 9 then 2 * cast(substr({d}, i, 1) as int) - 9 "
        f"else 2 * cast(substr({d}, i, 1) as int) end else cast(substr({d}, i, 1) as int) end)) % 10 = 0)"
    )


def valid_card(d: str) -> str:
    first4 = f"cast(substr({d}, 1, 4) as int)"
    return (
        f"(len({d}) between 13 and 19 and len(replace({d}, substr({d}, 1, 1), '')) > 0 and "
        f"(substr({d}, 1, 1) = '4' or substr({d}, 1, 2) in ('51','52','53','54','55','34','37','65','35','30','36','38') "
        f"or substr({d}, 1, 4) = '6011' or {first4} between 2221 and 2720) and {luhn(d)})"
    )


def valid_ssn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (
        f"(substr({d}, 1, 3) not in ('000', '666') and substr({d}, 1, 1) <> '9' "
        f"and substr({d}, 4, 2) <> '00' and substr({d}, 6, 4) <> '0000')"
    )


def valid_itin(v: str) -> str:
    g = f"cast(substr({v}, 5, 2) as int)"
    return f"({g} between 70 and 88 or {g} between 90 and 92 or {g} between 94 and 99)"


def valid_aba(v: str) -> str:
    total = " + ".join(f"{w} * cast(substr({v}, {i + 1}, 1) as int)" for i, w in enumerate((3, 7, 1) * 3))
    return f"(({total}) > 0 and ({total}) % 10 = 0)"


_VALID = {"valid_ssn": valid_ssn, "valid_itin": valid_itin, "valid_aba": valid_aba}


def _spans(pos: int, regex: str) -> str:
    sep = "chr(30)"
    return (
        f"select id, {pos} as d, "
        "cast(coalesce(list_sum(list_transform(pieces[1:k - 1], lambda p: len(p))), 0) as bigint) as s, "
        "pieces[k] as v from (select id, pieces, unnest(range(2, len(pieces), 2)) as k from "
        f"(select id, string_split(regexp_replace(b, {lit(regex)}, {sep} || '\\0' || {sep}, 'g'), {sep}) as pieces from src))"
    )


def _cards(pos: int, regex: str) -> str:
    """One search per round, resuming behind the card or the whole match."""
    return f"""
    select id, {pos} as d, cast(hit_at + pick.f as bigint) as s, substr(m, cast(pick.f as int) + 1, cast(pick.t - pick.f as int)) as v
    from card_walk where pick is not null"""


def _card_walk(regex: str) -> str:
    groups = "regexp_extract_all(m, '[0-9]+')"
    ends = f"list_transform(range(1, len(g) + 1), lambda i: len(array_to_string(g[1:i], ' ')))"
    joined = "array_to_string(g[o.a:o.z], '')"
    options = (
        "list_filter(flatten(list_transform(range(1, len(g) + 1), lambda a: list_transform("
        "list_reverse(range(a, len(g) + 1)), lambda z: {'a': a, 'z': z}))), "
        f"lambda o: {valid_card(joined)})"
    )
    step = f"""
        select id, b, hit_at, m,
               case when len(opts) > 0 then {{'f': ends[opts[1].a] - len(g[opts[1].a]), 't': ends[opts[1].z]}} end as pick
        from (select *, {options} as opts from
              (select *, {ends} as ends from (select *, {groups} as g from
               (select id, b, from_pos + len(regexp_extract(rest, {lit('(?s)^(.*?)' + regex)}, 1)) as hit_at,
                       regexp_extract(rest, {lit(regex)}) as m
                from (select id, b, from_pos, substr(b, from_pos + 1) as rest from XX)
                where regexp_matches(rest, {lit(regex)})))))"""
    start = "(select id, b, cast(0 as bigint) as from_pos from src)"
    resume = "(select id, b, cast(hit_at + coalesce(pick.t, len(m)) as bigint) as from_pos from card_walk)"
    return f"card_walk as ({step.replace('XX', start)} union all {step.replace('XX', resume)})"


def detection(src: str, id_col: str, text: str, categories=None, paged: bool = False, min_confidence: str = "low") -> str:
    """CTEs up to ``found``: id, category, confidence, conf, line, page, match,
    context, s, e."""
    chosen = DEFAULT.normalize(categories) or DEFAULT.categories()
    dets = [(i, d) for i, d in enumerate(DEFAULT_DETECTORS) if d.category in chosen]
    ctes = [f"src as materialized (select cast({id_col} as varchar) as id, {text} as txt, {byte_view(text)} as b from {src})"]
    parts = []
    for i, d in dets:
        if d.narrow_card:
            ctes.append(_card_walk(d.regex))
            parts.append(_cards(i, d.regex))
        else:
            parts.append(_spans(i, d.regex))
    ctes.append("spans as materialized (" + " union all ".join(parts) + ")")
    valid = " ".join(
        f"when {i} then {_VALID[d.validator.__name__]('v')}" for i, d in dets if d.validator
    )
    case = f"case d {valid} else true end" if valid else "true"
    ctes.append(f"valid as (select *, s + len(v) as e from spans where {case})")
    ctes.append(
        "windowed as (select valid.*, src.b, src.txt, "
        "array_to_string(list_slice(string_split(substr(b, greatest(s - 100, 0) + 1, s - greatest(s - 100, 0)), chr(10)), -2, -1), chr(10))"
        " || v || string_split(substr(b, e + 1, 100), chr(10))[1] as w from valid join src using (id))"
    )
    hit = " ".join(f"when {i} then regexp_matches(w, {lit(d.keywords)})" for i, d in dets if d.keywords)
    hit = f"case d {hit} else false end" if hit else "false"
    boosted = " ".join(f"when {i} then {d.boosted}" for i, d in dets)
    base = " ".join(f"when {i} then {-1 if d.keywords and d.need_keyword else d.base}" for i, d in dets)
    names = " ".join(f"when {i} then {lit(d.category)}" for i, d in dets)
    ctes.append(
        f"scored as (select *, case when {hit} then case d {boosted} end else case d {base} end end as conf, "
        f"case d {names} end as category from windowed)"
    )
    ctes.append(
        "best as (select *, max(conf) over (partition by id, s, e) as top, "
        "row_number() over (partition by id, s, e, category order by conf desc, d) as rn from scored where conf >= 0)"
    )
    pre = "substr(b, 1, s)"
    lines = f"len({pre}) - len(replace({pre}, chr(10), ''))"
    page, line = "cast(null as int)", f"1 + {lines}"
    if paged:
        last = f"list_slice(string_split({pre}, chr(12)), -1, -1)[1]"
        page = f"case when contains(b, chr(12)) then 1 + len({pre}) - len(replace({pre}, chr(12), '')) end"
        line = f"case when contains(b, chr(12)) then 1 + len({last}) - len(replace({last}, chr(10), '')) else 1 + {lines} end"
    # context: byte positions of the cut, then the same cut in characters
    ctes.append(
        f"""cut as (select *, substr(b, greatest(s - 61, 0) + 1, s - greatest(s - 61, 0)) as lb, substr(b, e + 1, 61) as rb,
        cast({line} as int) as line, cast({page} as int) as page
        from best where conf = top and rn = 1 and conf >= {_NAMES.index(min_confidence)})"""
    )
    ctes.append(
        """sides as (select *, len(lb) = 61 and not contains(lb, chr(10)) as cl, len(rb) = 61 and not contains(rb, chr(10)) as cr,
        case when len(lb) = 61 and not contains(lb, chr(10)) then regexp_replace(substr(lb, 2), '^\\x01+', '')
             else list_slice(string_split(lb, chr(10)), -1, -1)[1] end as l,
        case when len(rb) = 61 and not contains(rb, chr(10)) then
               case when substr(rb, 61, 1) = chr(1) then regexp_replace(substr(rb, 1, 60), '(?s)[^\\x01]\\x01*$', '') else substr(rb, 1, 60) end
             else string_split(rb, chr(10))[1] end as r from cut)"""
    )

    def chars(x: str) -> str:
        return f"(len({x}) - (len({x}) - len(replace({x}, chr(1), ''))))"

    before = "substr(b, 1, s - len(l))"
    shown = f"substr(txt, cast({chars(before)} + 1 as bigint), cast({chars('l')} + {chars('v')} + {chars('r')} as bigint))"
    ctes.append(
        f"""found as (select id, category, case conf when 2 then 'high' when 1 then 'medium' else 'low' end as confidence, conf,
        line, page, v as "match", (case when cl then '…' else '' end) || trim(regexp_replace({shown}, '[\\x00-\\x1F]', ' ', 'g'))
        || (case when cr then '…' else '' end) as context, cast(s as int) as s, cast(e as int) as e, d from sides)"""
    )
    return "with recursive " + ",\n".join(ctes)


def plain(category: str = "category") -> str:
    return f"{category} in ({', '.join(lit(c) for c in PLAIN_CATEGORIES)})"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def mask(x: str) -> str:
    alnum = f"len(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g'))"
    chars = f"string_split({x}, '')"
    seen = f"len(regexp_replace(substr({x}, 1, i), '[^0-9A-Za-z]', '', 'g'))"
    other = (
        f"array_to_string(list_transform(range(1, len({x}) + 1), lambda i: case when regexp_matches({chars}[i], '[0-9A-Za-z]') "
        f"and {seen} <= {alnum} - 4 then '*' else {chars}[i] end), '')"
    )
    at = f"instr({x}, '@')"
    return (
        f"(case when {at} > 1 and contains(substr({x}, {at}), '.') then substr({x}, 1, 1) || "
        f"repeat('*', strlen(substr({x}, 1, {at} - 1)) - 1) || substr({x}, {at}) else {other} end)"
    )


def masked(per: str = "id") -> str:
    """CTE ``masked_ctx``: found rows with masked context, replacing the
    document's values one after the other, longest first."""
    return f"""
    , vals as (select {per}, "match" as value, min(s) as first_at from found where not {plain()} group by all)
    , repl as (select {per}, list({{'v': value, 'm': {mask('value')}}} order by strlen(value) desc, first_at) as rs from vals group by {per})
    , steps as (
        select found.*, context as c, coalesce(rs, []) as rs, 1 as i from found left join repl using ({per})
        union all
        select * replace (replace(c, rs[i].v, rs[i].m) as c, i + 1 as i) from steps where i <= len(rs))
    , masked_ctx as (select * from steps where i = len(rs) + 1)"""


def csv_safe(x: str) -> str:
    return f"(case when regexp_matches({x}, '^[=+\\-@\\t\\r]') then '''' || {x} else {x} end)"


def cef_ext(x: str) -> str:
    return (
        f"replace(replace(replace(replace({x}, '\\', '\\\\'), '=', '\\='), chr(10), '\\n'), chr(13), '\\r')"
    )


__all__ = ["REDACTED", "csv_safe", "cef_ext", "detection", "lit", "mask", "masked", "plain", "slug"]
