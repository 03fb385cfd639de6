r"""RE2 patterns in the Java dialect that Spark's regexp functions evaluate.

Two views of a document are matched against:

* ``byte`` - one character per UTF-8 byte (Latin-1), where character offsets
  *are* byte offsets; used wherever positions matter;
* ``char`` - the string as it is; used by the cheap "could this document match
  at all" filter, which needs no positions.
"""

import re

# single characters: Java tests them with one table lookup, ranges one by one
_RANGES = {r: "".join(chr(c) for c in range(ord(r[0]), ord(r[2]) + 1)) for r in ("0-9", "A-Z", "a-z")}
WORD = "".join(_RANGES.values()) + "_"
_START = f"(?<![{WORD}])"
_END = f"(?![{WORD}])"
_BOUNDARY = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
_SPACE = r"\t\n\f\r "

# fixed values: the two non-ASCII letters that fold to ASCII ones
_FOLDS = {
    "byte": {"s": r"(?:s|\xC5\xBF)", "k": r"(?:k|\xE2\x84\xAA)"},
    "char": {"s": r"[s\u017F]", "k": r"[k\u212A]"},
}

_TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}|\(\?[a-z]*[:)]|.", re.S)


def to_java(pattern: str, view: str = "byte", word_edges: bool = False) -> str:
    r"""Translate ``pattern``.

    ``word_edges`` states that every ``\b`` stands directly before or after a
    word character inside the pattern, so one lookaround is enough for it.
    """
    folded = pattern.startswith("(?i)")
    body = pattern[4:] if folded else pattern
    tokens = _TOKEN.findall(body)
    out = ["(?i)" if folded else ""]
    for pos, token in enumerate(tokens):
        if token == r"\b":
            following = tokens[pos + 1] if pos + 1 < len(tokens) else ")"
            if not word_edges:
                out.append(_BOUNDARY)
            else:
                out.append(_END if following in (")", "|") else _START)
        elif token == r"\s":
            out.append(f"[{_SPACE}]")
        elif token.startswith("["):
            out.append(_listed(token.replace(r"\s", _SPACE)))
        elif folded and token.lower() in ("s", "k"):
            out.append(_FOLDS[view][token.lower()])
        else:
            out.append(token)
    return "".join(out)


def _listed(characters: str) -> str:
    """A character class with its common ranges written out."""
    for span, members in _RANGES.items():
        characters = characters.replace(span, members)
    return characters


def starting_with(java: str, first: str) -> str:
    """``java`` tried only where one of the characters ``first`` stands, with
    which each of its matches begins: one lookup instead of all alternatives."""
    flag = "(?i)" if java.startswith("(?i)") else ""
    return f"{flag}(?=[{first}])(?:{java.removeprefix(flag)})"


def without_boundaries(pattern: str) -> str:
    r"""``pattern`` minus its ``\b`` tests: true wherever ``pattern`` is, and
    also where a slice of the text would create a boundary."""
    return pattern.replace(r"\b", "")
