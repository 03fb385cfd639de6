"""A slow, separate statement of the rules over bytes, to compare with."""

import re

from veilscan.operators.detectors import DEFAULT_DETECTORS

WINDOW, RADIUS = 100, 60


def bytes_regex(pattern: str) -> re.Pattern:
    flags = 0
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], re.I
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i:i + 2]
            if pair == r"\s":
                pair = r"\t\n\f\r " if in_class else r"[\t\n\f\r ]"
            out.append(pair)
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif flags and not in_class and c in "sS":
            c = "(?:s|\xc5\xbf)"
        elif flags and not in_class and c in "kK":
            c = "(?:k|\xe2\x84\xaa)"
        out.append(c)
        i += 1
    return re.compile("".join(out).encode("latin-1"), flags)


def luhn(d: str) -> bool:
    total = 0
    for pos, c in enumerate(reversed(d)):
        n = int(c) * (1 + pos % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def card(d: str) -> bool:
    if not 13 <= len(d) <= 19 or len(set(d)) == 1:
        return False
    known = (
        d[0] == "4" or "51" <= d[:2] <= "55" or 2221 <= int(d[:4]) <= 2720
        or d[:2] in ("34", "37", "65", "35", "30", "36", "38") or d[:4] == "6011"
    )
    return known and luhn(d)


def card_in(run: bytes):
    groups = [m.span() for m in re.finditer(rb"[0-9]+", run)]
    for a in range(len(groups)):
        for b in range(len(groups) - 1, a - 1, -1):
            if card(re.sub(rb"[^0-9]", b"", run[groups[a][0]:groups[b][1]]).decode()):
                return groups[a][0], groups[b][1]
    return None


def valid(name: str, v: str) -> bool:
    d = re.sub("[^0-9]", "", v)
    if name == "valid_ssn":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if name == "valid_itin":
        return int(d[3:5]) in {*range(70, 89), *range(90, 93), *range(94, 100)}
    total = sum(w * int(c) for w, c in zip((3, 7, 1) * 3, d))
    return total > 0 and total % 10 == 0


def spans(det, text: bytes):
    rx = bytes_regex(det.regex)
    if not det.narrow_card:
        yield from (m.span() for m in rx.finditer(text))
        return
    pos = 0
    while pos < len(text):
        m = rx.search(text[pos:])
        if not m:
            return
        start, end = pos + m.start(), pos + m.end()
        inner = card_in(text[start:end])
        if inner:
            yield start + inner[0], start + inner[1]
            pos = start + inner[1]
        else:
            pos = end


def window(text: bytes, start: int, end: int) -> bytes:
    left = text[max(0, start - WINDOW):start].split(b"\n")[-2:]
    right = text[end:end + WINDOW].split(b"\n")[0]
    return b"\n".join(left) + text[start:end] + right


def snippet(text: bytes, start: int, end: int) -> str:
    line_start = text.rfind(b"\n", 0, start) + 1
    line_end = text.find(b"\n", end)
    line_end = len(text) if line_end < 0 else line_end
    left, right = max(line_start, start - RADIUS), min(line_end, end + RADIUS)
    pre = "…" if left > line_start else ""
    post = "…" if right < line_end else ""
    while left < start and 0x80 <= text[left] < 0xC0:
        left += 1
    while end < right < len(text) and 0x80 <= text[right] < 0xC0:
        right -= 1
    shown = text[left:right].decode("utf-8", "replace")
    return pre + "".join(" " if ord(c) < 32 else c for c in shown).strip() + post


def detect(text: bytes, detectors=DEFAULT_DETECTORS):
    """(start, end, category, confidence, line, context) in order."""
    found = []
    for order, det in enumerate(detectors):
        for start, end in spans(det, text):
            if det.validator and not valid(det.validator.__name__, text[start:end].decode()):
                continue
            conf = det.base
            if det.keywords:
                if bytes_regex(det.keywords).search(window(text, start, end)):
                    conf = det.boosted
                elif det.need_keyword:
                    continue
            found.append((start, -end, -conf, order, det.category))
    found.sort()
    kept, best = [], {}
    for start, neg_end, neg_conf, _, category in found:
        top, seen = best.setdefault((start, neg_end), (neg_conf, set()))
        if neg_conf > top or category in seen:
            continue
        seen.add(category)
        kept.append((start, -neg_end, category, ("low", "medium", "high")[-neg_conf],
                     1 + text[:start].count(b"\n"), snippet(text, start, -neg_end)))
    return kept
