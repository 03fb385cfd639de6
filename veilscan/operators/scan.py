"""Documents in, findings out: one narrow, map-only stage.

Everything below is a single Spark expression per document - an array of
matches built by higher-order functions - so a scan never shuffles, and the
per-document rules (overlap, masking) need no grouping either.  All offsets
are byte offsets into the document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce
from operator import and_

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.arrays import let, running_states
from veilscan.functions.regex import WORD
from veilscan.functions.scalars import category_slug, file_name
from veilscan.functions.validators import valid_card
from veilscan.operators.detectors import (
    CONFIDENCE_NAMES, DEFAULT, FAMILIES, Detector, Registry, any_of, parse_confidence,
)
from veilscan.operators.filters import excluded_email, normalize_email_excludes

KEYWORD_WINDOW = 100  # bytes searched for keywords on each side of a match
CONTEXT_RADIUS = 60  # bytes of context shown on each side of a match

_MARK = "Ā"  # cannot occur in the byte view, whose characters end at U+00FF
_ELLIPSIS = "…"
_PAGES = 1 << 32  # a place is its page times this plus its line

# fixed value: Unicode white space other than control characters
_UNICODE_SPACE = (
    " \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# a maximal run of digit groups joined by single spaces or hyphens that holds
# the 13 digits of a card; from a later group of a shorter run there are still
# fewer.  The possessive quantifiers keep Java from recursing on long runs
_DIGIT_RUN = f"(?<![{WORD}])(?=(?:[0-9][ -]?+){{12}}[0-9])[0-9]++(?:[ -][0-9]++)*+[A-Za-z_]?+"


def bytes_view(raw: Column) -> Column:
    """One character per byte."""
    return F.decode(raw, "ISO-8859-1")


def from_bytes_view(view: Column) -> Column:
    """Back to text; bytes that are not UTF-8 become U+FFFD."""
    return let(view, lambda v: F.when(_is_ascii(v), v).otherwise(_decoded(v)))


def _is_ascii(view: Column) -> Column:
    # the other characters of a view take two bytes each
    return F.octet_length(view) == F.length(view)


def _decoded(view: Column) -> Column:
    return F.make_valid_utf8(F.encode(view, "ISO-8859-1").cast("string"))


def _bytes_between(raw: Column, start: Column, end: Column) -> Column:
    return bytes_view(F.substring(raw, start + 1, end - start))


def _text_between(raw: Column, start: Column, end: Column) -> Column:
    """The bytes as they are: only for functions that look at single bytes, or
    for ASCII words and characters that are whole."""
    return F.substring(raw, start + 1, end - start).cast("string")


def find_spans(view: Column, java_regex: str) -> Column:
    """Leftmost, non-overlapping matches as ``array<struct<start,end,v>>``."""
    return let(_pieces(view, java_regex), lambda pieces: _spans_of_pieces(pieces))


def _pieces(view: Column, java_regex: str) -> Column:
    """gap, match, gap, match, ..., gap"""
    return F.split(F.regexp_replace(view, java_regex, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _spans_of_pieces(pieces: Column, *tags: Column) -> Column:
    lengths = F.transform(pieces, F.length)
    ends = running_states(lengths, F.lit(0), lambda pos, n: pos + n)
    return let(
        ends,
        lambda end_of: F.transform(
            F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda k: k % 2 == 0),
            lambda k: F.struct(
                *tags,
                F.element_at(end_of, k - 1).alias("start"),
                F.element_at(end_of, k).alias("end"),
                F.element_at(pieces, k).alias("v"),
            ),
        ),
    )


def narrow_cards(run: Column) -> Column:
    """Card numbers inside one digit run ``struct<start,end,v>``.

    A card is a contiguous sequence of whole digit groups.  From group *i* the
    card pattern takes the longest sequence of 13-19 digits; inside it the
    leftmost, then longest, valid sequence is the card and the search resumes
    behind it, or behind the whole sequence when none is valid.
    """
    groups = F.regexp_extract_all(run["v"], F.lit("[0-9]+"), 0)

    def of_groups(group: Column) -> Column:
        upto = running_states(group, F.lit(0), lambda count, g: count + F.length(g))
        joined = F.array_join(group, "")
        return let(upto, lambda count: let(joined, lambda number: cards(group, count, number)))

    def cards(group: Column, upto: Column, number: Column) -> Column:
        """``upto``: digits up to each group's end, ``number``: all of them."""

        def ahead_of(i: Column) -> Column:
            return F.coalesce(F.get(upto, i - 2), F.lit(0))

        def digits(i: Column, j: Column) -> Column:
            return F.element_at(upto, j) - ahead_of(i)

        def start_of(i: Column) -> Column:
            # separators are one byte each
            return ahead_of(i) + i - 1

        def end_of(j: Column) -> Column:
            return F.element_at(upto, j) + j - 1

        def ahead(i: Column) -> Column:
            """Last groups of sequences from ``i`` that hold at most 19 digits."""
            return F.filter(
                F.sequence(i, F.least(i + 18, F.size(group))), lambda j: digits(i, j) <= 19
            )

        def between(i: Column, j: Column) -> Column:
            return F.substring(number, ahead_of(i) + 1, digits(i, j))

        def pick(i: Column, last: Column) -> Column:
            """Leftmost, then longest, valid sequence within groups i..last."""
            options = F.flatten(
                F.transform(
                    F.sequence(i, last),
                    lambda a: F.transform(
                        F.filter(
                            F.sequence(last, a, F.lit(-1)),
                            lambda b: (digits(a, b) >= 13) & let(between(a, b), valid_card),
                        ),
                        lambda b: F.struct(a.alias("a"), b.alias("b")),
                    ),
                )
            )
            return F.get(options, F.lit(0))

        nothing = F.lit(None).cast("struct<a:int,b:int>")

        def state(resume: Column, card: Column) -> Column:
            return F.struct(resume.cast("int").alias("resume"), card.alias("card"))

        def step(before: Column, i: Column) -> Column:
            def from_here(options: Column) -> Column:
                last = F.element_at(options, -1)
                return F.when(
                    (F.size(options) == 0) | (digits(i, last) < 13), state(i + 1, nothing)
                ).otherwise(
                    let(
                        pick(i, last),
                        lambda card: state(F.coalesce(card["b"], last) + 1, card),
                    )
                )

            return F.when(i < before["resume"], state(before["resume"], nothing)).otherwise(
                let(ahead(i), from_here)
            )

        walked = running_states(F.sequence(F.lit(1), F.size(group)), state(F.lit(1), nothing), step)
        found = F.filter(walked, lambda s: s["card"].isNotNull())
        return F.transform(
            found,
            lambda s: let(
                s["card"],
                lambda card: F.struct(
                    (run["start"] + start_of(card["a"])).alias("start"),
                    (run["start"] + end_of(card["b"])).alias("end"),
                    F.substring(
                        run["v"],
                        start_of(card["a"]) + 1,
                        end_of(card["b"]) - start_of(card["a"]),
                    ).alias("v"),
                ),
            ),
        )

    return let(groups, of_groups)


def _card_spans(view: Column) -> Column:
    # a last group that goes on as a word is not part of the run
    whole = F.transform(
        find_spans(view, _DIGIT_RUN),
        lambda run: F.struct(
            run["start"].alias("start"),
            run["end"].alias("end"),
            F.regexp_replace(run["v"], r"(?:^|[ -])[0-9]++[A-Za-z_]\z", "").alias("v"),
        ),
    )
    runs = F.filter(whole, lambda run: F.length(F.translate(run["v"], " -", "")) >= 13)
    return F.flatten(F.transform(runs, narrow_cards))


def context_window(raw: Column, start: Column, end: Column) -> Column:
    """What is searched for keywords: the match's own line and the line above
    it, at most 100 bytes on each side."""
    left = _text_between(raw, F.greatest(start - KEYWORD_WINDOW, F.lit(0)), start)
    right = _text_between(raw, end, end + KEYWORD_WINDOW)
    return F.concat(
        F.substring_index(left, "\n", -2), _text_between(raw, start, end), F.substring_index(right, "\n", 1)
    )


def context_snippet(raw: Column, start: Column, end: Column, value: Column) -> Column:
    """The match's line, at most 60 bytes of it on each side, cut at character
    boundaries and marked with an ellipsis where cut."""
    reach = CONTEXT_RADIUS + 1
    before = _bytes_between(raw, F.greatest(start - reach, F.lit(0)), start)
    after = _bytes_between(raw, end, end + reach)

    def build(sides: Column) -> Column:
        b, a = sides["b"], sides["a"]
        cut_left = (F.length(b) == reach) & ~b.contains("\n")
        cut_right = (F.length(a) == reach) & ~a.contains("\n")
        left = F.when(cut_left, F.substring(b, 2, CONTEXT_RADIUS)).otherwise(F.substring_index(b, "\n", -1))
        left = F.regexp_replace(left, "^[\\x80-\\xBF]+", "")
        kept = F.substring(a, 1, CONTEXT_RADIUS)
        right = (
            F.when(
                cut_right & F.substring(a, reach, 1).rlike("[\\x80-\\xBF]"),
                F.regexp_replace(kept, "(?s)[^\\x80-\\xBF]?[\\x80-\\xBF]*\\z", ""),
            )
            .when(cut_right, kept)
            .otherwise(F.substring_index(a, "\n", 1))
        )
        shown = F.regexp_replace(F.concat(left, value, right), "[\\x00-\\x1F]", " ")
        shown = let(
            shown,
            lambda v: F.when(_is_ascii(v), F.trim(v)).otherwise(F.trim(_decoded(v), F.lit(_UNICODE_SPACE))),
        )
        return F.concat(
            F.when(cut_left, F.lit(_ELLIPSIS)).otherwise(F.lit("")),
            shown,
            F.when(cut_right, F.lit(_ELLIPSIS)).otherwise(F.lit("")),
        )

    return let(F.struct(before.alias("b"), after.alias("a")), build)


def _count(text: Column, char: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def locate(raw: Column, starts: Column, paged: Column) -> Column:
    """Line (and page) of each ascending byte offset in ``starts``.

    Each stretch of text between two offsets is looked at once.  In paged text
    (pages joined by form feeds) lines restart on every page.
    """

    def stretch(start: Column, i: Column) -> Column:
        """Pages and lines passed, as one number: a running state is copied
        with all earlier ones."""
        since = F.coalesce(F.get(starts, i - 1), F.lit(0))
        return let(_text_between(raw, since, start), lambda s: F.when(paged, on_pages(s)).otherwise(_count(s, "\n").cast("long")))

    def on_pages(s: Column) -> Column:
        last = let(F.substring_index(s, "\f", -1), lambda rest: _count(rest, "\n"))
        return _count(s, "\f") * _PAGES + last

    def step(at: Column, moved: Column) -> Column:
        restarted = F.shiftright(at, 32) * _PAGES + 1
        return F.when(moved < _PAGES, at + moved).otherwise(restarted + moved)

    places = running_states(F.transform(starts, stretch), F.lit(_PAGES + 1), step)
    return F.transform(
        places,
        lambda at: F.struct(
            (at % _PAGES).cast("int").alias("line"), F.shiftright(at, 32).cast("int").alias("page")
        ),
    )


def dedupe_spans(matches: Column, reach: int) -> Column:
    """Of matches on the identical span keep the most confident; categories
    that tie are all kept, one category never twice.

    ``matches`` is sorted by (start, end descending, confidence descending,
    detector), so equal spans are neighbours and at most ``reach`` apart.
    """

    def repeated(m: Column, i: Column) -> Column:
        def same_span(p: Column) -> Column:
            return (p["start"] == m["start"]) & (p["neg_end"] == m["neg_end"])

        earlier = F.slice(matches, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)))
        beaten = F.exists(
            earlier,
            lambda p: same_span(p)
            & ((p["neg_conf"] < m["neg_conf"]) | (p["category"] == m["category"])),
        )
        # most spans have no neighbour: only then look further back
        return F.when(same_span(F.get(matches, i - 1)), beaten).otherwise(F.lit(False))

    return F.filter(matches, lambda m, i: ~repeated(m, i))


def _found_together(detectors: Sequence[Detector]) -> list[tuple[Detector, dict[int, Detector]]]:
    """Rules to search for, each with the detectors (by position) that it serves."""
    shared: dict[object, dict[int, Detector]] = {}
    for pos, det in enumerate(detectors):
        shared.setdefault(det.family or pos, {})[pos] = det
    return [
        (FAMILIES[key] if len(members) > 1 else next(iter(members.values())), members)
        for key, members in shared.items()
    ]


def _scored(raw: Column, view: Column, registry: Registry) -> Column:
    together = _found_together(registry.detectors)
    sources = []
    for group, (rule, members) in enumerate(together):
        if not rule.narrow_card:
            gate = any_of([d.could_match(view, "byte", search=False) for d in members.values()])
            if rule.needs:
                gate = view.rlike(rule.needs) & gate
            pieces = F.when(gate, _pieces(view, rule.java("byte")))
            sources.append(F.struct(F.lit(group).alias("group"), pieces.alias("pieces")))
    found = []
    if sources:
        hit = F.filter(F.array(*sources), lambda s: F.size(s["pieces"]) > 1)
        found.append(F.flatten(F.transform(hit, lambda s: _spans_of_pieces(s["pieces"], s["group"].alias("group")))))
    nothing = F.array().cast("array<struct<start:int,end:int,v:string>>")

    def tagged(group: int, cards: Column) -> Column:
        return F.transform(cards, lambda m: F.struct(F.lit(group).alias("group"), m["start"], m["end"], m["v"]))

    for group, (rule, _) in enumerate(together):
        if rule.narrow_card:
            found.append(tagged(group, F.when(rule.could_match(view, "byte"), _card_spans(view)).otherwise(nothing)))
    spans = found[0] if len(found) == 1 else F.concat(*found)

    def match(m: Column, pos: int, det: Detector, together: bool, window: Column) -> Column:
        """The detector's match at a span, null where it has none."""
        tests = [det.covers(m["v"])] if together else []
        if det.validator:
            tests.append(det.validator(m["v"]))
        confidence = F.lit(-det.base)
        if _needs_window(det):
            hit = window.rlike(det.keyword_java("char"))
            if det.need_keyword:
                tests.append(hit)
                confidence = F.lit(-det.boosted)
            else:
                confidence = F.when(hit, F.lit(-det.boosted)).otherwise(confidence)
        out = F.struct(
            m["start"].alias("start"),
            (-m["end"]).alias("neg_end"),
            confidence.alias("neg_conf"),
            F.lit(pos).alias("d"),
            m["v"].alias("v"),
            F.lit(det.category).alias("category"),
        )
        return F.when(reduce(and_, tests), out) if tests else out

    def matches(m: Column, members: dict[int, Detector]) -> Column:
        def of_window(window: Column) -> Column:
            return F.array(*[match(m, pos, det, len(members) > 1, window) for pos, det in members.items()])

        window = context_window(raw, m["start"], m["end"])
        # one that a single test reads is not computed before the others
        return let(window, of_window) if sum(map(_needs_window, members.values())) > 1 else of_window(window)

    def of_span(m: Column) -> Column:
        cases = [(m["group"] == group, matches(m, members)) for group, (_, members) in enumerate(together)]
        first, *others = cases
        return reduce(lambda case, other: case.when(*other), others, F.when(*first))

    return F.array_sort(F.filter(F.flatten(F.transform(spans, of_span)), lambda m: m.isNotNull()))


def _needs_window(det: Detector) -> bool:
    """Whether keywords change anything."""
    return bool(det.keywords) and (det.need_keyword or det.base != det.boosted)


def detect(
    content: Column,
    registry: Registry = DEFAULT,
    min_confidence: str | int = "low",
    exclude_emails: Sequence[str] = (),
    paged: Column | None = None,
) -> Column:
    """All findings of one document as an array of structs; null when a first
    look rules out that there are any.

    ``content`` is STRING or BINARY.  ``paged`` marks documents whose form
    feeds separate pages (OCR output, attachments); the others carry no page.
    The first look is part of the expression rather than a filter below it: a
    filter would be pushed through the projection that computes ``content``
    and compute it once more for every detector.
    """
    floor = parse_confidence(min_confidence)
    emails = tuple(normalize_email_excludes(exclude_emails))
    with_pages = F.lit(False) if paged is None else F.coalesce(paged, F.lit(False))

    def on_raw(raw: Column) -> Column:
        return let(bytes_view(raw), lambda view: on_view(raw, view))

    def on_view(raw: Column, view: Column) -> Column:
        reach = max(len(registry.detectors) - 1, 1)
        is_paged = with_pages & view.contains("\f")
        return let(
            _scored(raw, view, registry),
            lambda scored: let(dedupe_spans(scored, reach), lambda m: let(is_paged, lambda p: finish(raw, m, p))),
        )

    def finish(raw: Column, matches: Column, is_paged: Column) -> Column:
        places = locate(raw, F.transform(matches, lambda m: m["start"]), is_paged)
        located = let(
            places,
            lambda place: F.transform(
                matches, lambda m, i: F.struct(m.alias("m"), F.get(place, i).alias("at"))
            ),
        )

        def kept(x: Column) -> Column:
            condition = -x["m"]["neg_conf"] >= floor
            if emails:
                condition = condition & ~excluded_email(x["m"]["category"], x["m"]["v"], emails)
            return condition

        if floor > 0 or emails:
            located = F.filter(located, kept)
        return F.transform(located, lambda x: shape(raw, x["m"], x["at"], is_paged))

    def shape(raw: Column, m: Column, at: Column, is_paged: Column) -> Column:
        end = -m["neg_end"]
        return F.struct(
            m["category"].alias("category"),
            F.element_at(F.array(*[F.lit(n) for n in CONFIDENCE_NAMES]), 1 - m["neg_conf"]).alias("confidence"),
            at["line"].alias("line"),
            F.when(is_paged, at["page"]).alias("page"),
            from_bytes_view(m["v"]).alias("match"),
            context_snippet(raw, m["start"], end, m["v"]).alias("context"),
            m["start"].alias("start"),
            end.alias("end"),
        )

    return let(
        content,
        lambda doc: F.when(registry.could_match(doc.cast("string")), let(doc.cast("binary"), on_raw)),
    )


@lru_cache(maxsize=64)
def _detect_named(text_col, detectors, floor, emails, transform_findings, _context) -> Column:
    """The expression refers to its column by name, so it serves any table;
    building it takes a few thousand calls into the JVM."""
    found = detect(F.col(text_col), Registry(detectors), floor, emails)
    return found if transform_findings is None else transform_findings(found)


def with_findings(
    df: DataFrame,
    text: str,
    *,
    registry: Registry = DEFAULT,
    categories: Sequence[str] | None = None,
    min_confidence: str | int = "low",
    exclude_emails: Sequence[str] = (),
    paged: Column | None = None,
    only_hits: bool = False,
    name: str = "findings",
) -> DataFrame:
    """``df`` plus an array of findings per row, without the text itself.

    With ``only_hits`` rows without findings are dropped, otherwise they stay
    with an empty array.
    """
    found = detect(F.col(text), registry.only(categories), min_confidence, exclude_emails, paged)
    out = df.select(*[c for c in df.columns if c != text], F.coalesce(found, F.array()).alias(name))
    return out.where(F.size(name) > 0) if only_hits else out


def scan_table(
    df: DataFrame,
    id_col: str,
    text_col: str,
    *,
    path_col: str | None = None,
    keep: Sequence[str] = (),
    registry: Registry = DEFAULT,
    categories: Sequence[str] | None = None,
    min_confidence: str | int = "low",
    exclude_emails: Sequence[str] = (),
    ocr: Column | None = None,
    paged: Column | None = None,
    transform_findings=None,
) -> DataFrame:
    """Findings over a text column of any table, one row per finding.

    ``ocr`` flags text read by OCR, ``paged`` text whose form feeds separate
    pages (by default the same).
    ``transform_findings`` may rewrite the per-document array (masking) before
    it is exploded, where all findings of a document are still together.
    """
    chosen = registry.only(categories)
    text = F.col(text_col)
    is_ocr = F.lit(False) if ocr is None else F.coalesce(ocr, F.lit(False))
    pages = ocr if paged is None else paged
    if pages is None:
        found = _detect_named(
            text_col, chosen.detectors, parse_confidence(min_confidence), tuple(exclude_emails),
            transform_findings, id(SparkContext._active_spark_context),
        )
    else:
        found = detect(text, chosen, min_confidence, exclude_emails, pages)
        if transform_findings is not None:
            found = transform_findings(found)
    path = F.col(path_col) if path_col else F.col(id_col)
    # exploding the expression itself (not a column holding it) keeps Spark
    # from inferring a size() filter that would run the whole scan twice
    rows = df.select(
        # names no input column has: a lambda must not take them for its own
        F.col(id_col).cast("string").alias("_doc_id"),
        path.cast("string").alias("_path"),
        F.when(is_ocr, F.lit(True)).alias("_ocr"),
        *[F.col(c) for c in keep],
        F.explode(found).alias("_f"),
    )
    return _finding_columns(rows, keep)


def _finding_columns(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns of a findings table from ``_doc_id, _path, _ocr, _f``."""
    return rows.select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_path").alias("path"),
        file_name(F.col("_path")).alias("file_name"),
        F.col("_f.category").alias("category"),
        category_slug(F.col("_f.category")).alias("category_id"),
        F.col("_f.confidence").alias("confidence"),
        F.col("_f.line").alias("line"),
        F.col("_f.page").alias("page"),
        F.col("_f.match").alias("match"),
        F.col("_f.context").alias("context"),
        F.col("_ocr").alias("ocr"),
        F.col("_f.start").alias("start"),
        F.col("_f.end").alias("end"),
        *keep,
    )


def explode_findings(df: DataFrame, id_col: str, findings: str, ocr: Column, keep: Sequence[str] = ()) -> DataFrame:
    """A findings table from a stored column of findings arrays."""
    rows = df.select(
        F.col(id_col).cast("string").alias("_doc_id"),
        F.col(id_col).cast("string").alias("_path"),
        F.when(ocr, F.lit(True)).alias("_ocr"),
        *keep,
        F.explode(findings).alias("_f"),
    )
    return _finding_columns(rows, keep)
