"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"
_LOWERED = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _repair_step() -> tuple[str, str, str]:
    """SQL of the states before the first row, of a fold over rows x of (initial,
    forced, unfinished), and of the end. A state is {cost, audit}; st[1..4] are:
    nothing yet, after a system, a user, an assistant row."""

    def to(source: str, cost: str, letter: str) -> str:
        return f"{{'cost': {source}.cost + {cost}, 'audit': {source}.audit || '{letter}'}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def inserted(st: str) -> str:
        user = least(f"{st}[3]", *(to(f"{st}[{i}]", "2", "I") for i in (1, 2, 4)))
        assistant = least(f"{st}[4]", to(f"{st}[3]", "2", "I"), *(to(f"{st}[{i}]", "4", "II") for i in (1, 2)))
        return f"[{st}[1], {st}[2], {user}, {assistant}]"

    late = "CASE WHEN x.unfinished THEN 1 ELSE 0 END"
    kept = f"(CASE WHEN x.forced OR x.initial <> '{{}}' THEN 1000000000 ELSE {late} END)".format
    changed = f"(CASE WHEN x.forced THEN 1000000000 ELSE 2 + {late} END)"
    new = [
        to("s[1]", "3", "D"),
        least(to("s[2]", "3", "D"), to("s[1]", kept("s"), "K")),
        least(to("s[3]", "3", "D"), *(to(f"s[{i}]", c, e) for i in (1, 2, 4) for c, e in ((kept("u"), "K"), (changed, "R")))),
        least(to("s[4]", "3", "D"), to("s[3]", kept("a"), "K"), to("s[3]", changed, "R")),
    ]
    step = f"list_transform([{inserted('st')}], lambda s: [{', '.join(new)}])[1]"
    first = "[{'cost': 0::BIGINT, 'audit': ''}" + ", {'cost': 1000000000::BIGINT, 'audit': ''}" * 3 + "]"
    return first, step, f"list_transform([{inserted('st')}], lambda s: {least('s[1]', 's[4]')})[1]"


_FIRST, _STEP, _END = _repair_step()

ORACLE = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWERED)} ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, md5(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
                ELSE array_to_string(ws[i:i + 4], ' ') END) h
            FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0
        ),
        n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
        both_sides AS (
            SELECT a.doc_id a, b.doc_id b, count(*) both_have FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM both_sides JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)
        ),
        reach AS (
            SELECT doc_id a, doc_id b FROM documents
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, c.low component_id
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT a doc_id, min(b) low FROM reach GROUP BY a) c USING (doc_id)
    """,
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        p AS (
            SELECT q.vec_id query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT score
            FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        e AS (
            SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': '
                || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) formatted
            FROM c
        )
        SELECT conv_id, count(*) n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
            sum(length(formatted))::BIGINT formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op9_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(_TEXT)} ws FROM documents),
        v AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) h
            FROM w, unnest(range(1, greatest(len(ws) - 48, 1))) t(i)
        ),
        f AS (SELECT h, min(doc_id) low FROM v GROUP BY h),
        gone AS (
            SELECT DISTINCT doc_id, i + k AS i FROM v JOIN f USING (h), unnest(range(0, 50)) t(k) WHERE low < doc_id
        ),
        kept AS (
            SELECT x.doc_id, count(*) n, string_agg(x.word, ' ' ORDER BY x.i) words
            FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) i, unnest(ws) word FROM w) x
            ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id
        )
        SELECT doc_id, len(ws)::BIGINT n_words, (len(ws) - coalesce(n, 0))::BIGINT n_removed,
            sha256(coalesce(words, '')) kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op10_quality_rules": rf"""
        WITH w AS (
            SELECT doc_id, {_TEXT} AS text, {_WORDS.format(_TEXT)} ws,
                list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
            FROM documents
        ),
        v AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) h
            FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) t(i)
        ),
        twice AS (SELECT doc_id, h FROM v GROUP BY ALL HAVING count(*) > 1),
        covered AS (
            SELECT doc_id, count(DISTINCT i + k) n FROM v JOIN twice USING (doc_id, h), unnest(range(0, 8)) t(k) GROUP BY doc_id
        ),
        m AS (
            SELECT doc_id, len(ws)::BIGINT n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, len(ls) n_lines,
                length(regexp_replace(text, '\PL', '', 'g')) n_letters, coalesce(n, 0)::BIGINT n_repeat_words
            FROM w LEFT JOIN covered USING (doc_id)
        ),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
                OR 100 * n_dup_lines > 50 * n_lines OR 2 * n_letters < word_chars) kept
        FROM b
    """,
    "op11_collocations": rf"""
        WITH p AS (
            SELECT coalesce(lang, 'und') lang,
                regexp_extract_all(unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') ws
            FROM documents
        ),
        g AS (
            SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase, count(*) f
            FROM p, unnest(range(1, len(ws) + 1)) t(i), unnest([1, 2, 3, 4]) u(k)
            WHERE i + k - 1 <= len(ws) GROUP BY ALL
        ),
        n AS (SELECT lang, sum(f)::BIGINT n FROM g WHERE k = 1 GROUP BY lang),
        h AS (SELECT *, string_split(phrase, ' ') ws FROM g WHERE f >= 30),
        cuts AS (
            SELECT c.lang, c.phrase, c.f a, j, x.f l, y.f r,
                (2000000::HUGEINT * c.f // (x.f::HUGEINT + y.f))::BIGINT score
            FROM h c, unnest(range(1, c.k)) t(j)
            JOIN h x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
            JOIN h y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')
        ),
        best AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ),
        longer AS (
            SELECT lang, array_to_string(ws[i:i + s - 1], ' ') phrase, max(f) f
            FROM h, unnest(range(2, k)) t(s), unnest(range(1, 4)) u(i) WHERE i + s - 1 <= k GROUP BY ALL
        ),
        o AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
            FROM best b LEFT JOIN longer w ON w.lang = b.lang AND w.phrase = b.phrase
            WHERE w.f IS NULL OR 100 * w.f < 80 * a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op12_turn_repair": rf"""
        WITH k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') key
            FROM conversations
        ),
        d AS (
            SELECT *, xor(list_reduce(
                list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT),
                lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
                4294967295::BIGINT
            ), 4294967295) % 20 kind
            FROM k
        ),
        r AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM d, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) t(i) WHERE kind <> 0
        ),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) i,
                left(role, 1) initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') blank,
                NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') unfinished
            FROM r
        ),
        f AS (
            SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 duplicate,
                initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) pair
            FROM o
        ),
        c AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps,
                count(*) FILTER (blank) blank, count(*) FILTER (duplicate) duplicate,
                count(*) FILTER (unfinished AND NOT blank AND NOT duplicate) truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) illegal,
                list({{'initial': initial, 'forced': blank OR duplicate, 'unfinished': unfinished}} ORDER BY i) xs
            FROM f GROUP BY conv_id
        ),
        b AS (
            SELECT * EXCLUDE (xs, st), {_END} best
            FROM (SELECT *, list_reduce(xs, lambda st, x: {_STEP}, {_FIRST}) st FROM c)
        ),
        e AS (
            SELECT conv_id, j, best.audit[j] edit,
                length(regexp_replace(best.audit[1:j], 'I', '', 'g')) i, length(regexp_replace(best.audit[1:j], 'D', '', 'g')) place
            FROM b, unnest(range(1, length(best.audit) + 1)) t(j)
        ),
        lines AS (
            SELECT e.conv_id, j, place, edit, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
                first_value(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY e.conv_id ORDER BY j) system_first
            FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND edit <> 'I'
            WHERE edit <> 'D'
        ),
        h AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system_first) % 2 = 1 THEN 'user'
                ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) whole
            FROM lines GROUP BY conv_id
        ),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate,
            coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal, coalesce(best.cost, 0)::BIGINT AS cost,
            coalesce(best.audit, '') audit, sha256(coalesce(whole, '')) repaired_sha256
        FROM ids LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM ids.conv_id
    """,
}
