"""The detector registry: what is looked for, and how sure a hit is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions import patterns as P
from veilscan.functions import validators as V
from veilscan.functions.regex import starting_with, to_java, without_boundaries

LOW, MEDIUM, HIGH = 0, 1, 2
CONFIDENCE_NAMES = ("low", "medium", "high")

# categories whose match is an indicator rather than a secret
PLAIN_CATEGORIES = (P.MARKING, P.SCOPE)


def parse_confidence(level: str | int) -> int:
    if isinstance(level, int):
        return level
    try:
        return CONFIDENCE_NAMES.index(level.lower())
    except ValueError:
        raise ValueError(f"unknown confidence {level!r} (use low, medium or high)") from None


@dataclass(frozen=True)
class Detector:
    r"""One rule.  Without a keyword hit a match scores ``base`` (or is dropped
    when ``need_keyword``); with one it scores ``boosted``.  ``validator`` is a
    boolean column over the matched value.  ``narrow_card`` searches digit runs
    for card numbers instead of taking the regex match itself.

    The remaining fields change the cost of a rule, never its result:

    * ``hint`` - ``(characters, ending)``: every match contains one of these
      characters, directly at the end of ``ending``.  Rare characters make the
      one-pass test of a document for *all* detectors cheap.
    * ``literals`` - every match contains one of these substrings.
    * ``needs`` - a simpler regex that matches wherever this one does.
    * ``first`` - class of the first character of every match.
    * ``word_edges`` - every ``\b`` stands next to a word character.
    * ``run_of`` - the match starts with a run of this class; it is only tried
      from the start of such a run, so long runs are not rescanned.
    * ``family`` - a wider rule, found once for all detectors that name it: the
      matches of each are those of the family that its regex covers as a whole.
    """

    category: str
    regex: str
    keywords: str | None = None
    need_keyword: bool = False
    base: int = MEDIUM
    boosted: int = MEDIUM
    validator: Callable[[Column], Column] | None = None
    narrow_card: bool = False
    hint: tuple[tuple[str, str], ...] = ()
    literals: tuple[str, ...] = ()
    needs: str | None = None
    first: str | None = None
    word_edges: bool = False
    run_of: str | None = None
    family: str | None = None

    def covers(self, value: Column) -> Column:
        """Whether a match of the family is one of this detector."""
        return value.rlike(rf"\A(?:{to_java(self.regex, 'byte', self.word_edges)})\z")

    def java(self, view: str) -> str:
        pattern = to_java(self.regex, view, self.word_edges)
        flag = "(?i)" if pattern.startswith("(?i)") else ""
        pattern = pattern.removeprefix(flag)
        if self.run_of:
            pattern = rf"(?:\G|(?<!{self.run_of})){pattern}"
        if self.first:
            pattern = f"(?={self.first})(?:{pattern})"
        return flag + pattern

    def keyword_java(self, view: str = "byte", boundaries: bool = True) -> str:
        java = to_java(self.keywords if boundaries else without_boundaries(self.keywords), view)
        starts = P.KEYWORD_STARTS.get(self.keywords)
        if starts is None:
            return java
        first = "".join(c + c.upper() if c.isalpha() else c for c in starts)
        if "s" in starts:  # the long s folds to it
            first += r"\xC5" if view == "byte" else r"\u017F"
        return starting_with(java, first)

    def could_match(self, text: Column, view: str = "char", search: bool = True) -> Column:
        """True for every document in which this detector finds something.
        Without ``search`` a lone regex is left out: the caller runs it anyway."""
        checks = []
        if self.literals:
            checks.append(any_of([text.contains(literal) for literal in self.literals]))
        if self.needs:
            checks.append(text.rlike(self.needs))
        gated = bool(self.keywords and self.need_keyword)
        if search or gated:
            checks.append(text.rlike(self.java(view)))
        if gated:
            # without \b: the edge of the keyword window is a boundary, too
            checks.append(text.rlike(self.keyword_java(view, boundaries=False)))
        return reduce(and_, checks) if checks else F.lit(True)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


# single characters: Java tests them with one table lookup, ranges one by one
DIGIT = "[0123456789]"


def _digit(category: str, regex: str, first: str | None = DIGIT, **kw) -> Detector:
    return Detector(category, regex, hint=(("0123456789", DIGIT),), first=first, word_edges=True, **kw)


def _phrase(category: str, regex: str, *hint: tuple[str, str], **kw) -> Detector:
    return Detector(category, regex, hint=hint, boosted=HIGH, **kw)


# a whole word of digits, which may begin with a letter
NUMBER_WORD = Detector("", r"\b[A-Za-z]?\d{5,17}\b", needs="[0-9]{5}", word_edges=True)
# of matches with these lengths no two overlap
DASHED_NUMBER = Detector("", P.RE_SSN_DASHED, first=DIGIT, word_edges=True)
FAMILIES = {"number": NUMBER_WORD, "dashed": DASHED_NUMBER}


DEFAULT_DETECTORS: tuple[Detector, ...] = (
    _digit(P.SSN, P.RE_SSN_DASHED, keywords=P.KW_SSN, base=HIGH, boosted=HIGH, validator=V.valid_ssn, family="dashed"),
    _digit(P.SSN, P.RE_SSN_BARE, keywords=P.KW_SSN, need_keyword=True, boosted=HIGH, validator=V.valid_ssn,
           family="number"),
    _digit(P.SSN, P.RE_SSN_SPACED, keywords=P.KW_SSN, need_keyword=True, boosted=HIGH, validator=V.valid_ssn),
    _digit(P.ITIN, P.RE_ITIN, "9", keywords=P.KW_SSN, base=HIGH, boosted=HIGH, validator=V.valid_itin, family="dashed"),
    _digit(P.CREDIT_CARD, P.RE_CARD, base=HIGH, boosted=HIGH, narrow_card=True),
    Detector(P.EMAIL, P.RE_EMAIL, hint=(("@", "@"),), literals=("@",), word_edges=True,
             run_of=r"[A-Za-z0-9._%+\-]"),
    _digit(P.PHONE, P.RE_PHONE, "[0123456789+(]", keywords=P.KW_PHONE, boosted=HIGH),
    _digit(P.DATE_OF_BIRTH, P.RE_DATE, "[0-9JFMASONDjfmasond]", needs="[0-9]{2}", keywords=P.KW_DOB,
           need_keyword=True, boosted=HIGH),
    _digit(P.DRIVERS_LICENSE, P.RE_LICENSE, None, needs="[0-9]{4}", keywords=P.KW_LICENSE, need_keyword=True),
    _digit(P.PASSPORT, P.RE_PASSPORT, None, needs="[0-9]{8}", keywords=P.KW_PASSPORT, need_keyword=True,
           family="number"),
    _digit(P.ROUTING, P.RE_ROUTING, keywords=P.KW_ROUTING, need_keyword=True, base=HIGH, boosted=HIGH,
           validator=V.valid_aba, family="number"),
    _digit(P.ACCOUNT, P.RE_ACCOUNT, keywords=P.KW_ACCOUNT, need_keyword=True, family="number"),
    _digit(P.MEDICARE, P.RE_MEDICARE, "[1-9]", keywords=P.KW_MEDICARE, boosted=HIGH),
    _digit(P.MEDICAL_RECORD, P.RE_MEDICAL_RECORD, keywords=P.KW_MEDICAL_RECORD, need_keyword=True,
           family="number"),
    _digit(P.DIAGNOSIS, P.RE_DIAGNOSIS, "[A-TV-Z]", needs="[0-9][.][0-9]", keywords=P.KW_DIAGNOSIS,
           need_keyword=True),
    _phrase(P.MARKING, P.RE_MARKING_PHRASE, ("dD", "[lLfF][eE][dD]"), base=HIGH, first="[CFcf]",
            word_edges=True),
    # the closing \b may follow '/', '+', '=' or '-', so it stays a full test
    _phrase(P.MARKING, P.RE_CUI, ("U", "CU"), keywords=P.KW_MARKING, literals=("CUI",), first="C"),
    _phrase(P.MARKING, P.RE_FCI, ("C", "FC"), keywords=P.KW_MARKING, literals=("FCI",), first="F",
            word_edges=True),
    _phrase(P.MARKING, P.RE_TLP, ("pP", "[lL][pP]"), base=HIGH, first="[Tt]", word_edges=True),
    _phrase(P.SCOPE, P.RE_EXPORT_PHRASE, ("fF", "[tT][rR][aA][fF]"), ("pP", "[xX][pP]"),
            ("bB", "[tT][rR][iI][bB]"), base=HIGH, first="[IEDied]", word_edges=True),
    _phrase(P.SCOPE, P.RE_EXPORT_ACRONYM, ("A", "ITA|EA"), keywords=P.KW_EXPORT, literals=("ITAR", "EAR99"),
            first="[IE]", word_edges=True),
    _digit(P.SCOPE, P.RE_DFARS, "2", base=HIGH, boosted=HIGH, literals=("252.204-70",)),
    _digit(P.SCOPE, P.RE_NIST, "8", keywords=P.KW_NIST, boosted=HIGH, literals=("800-171",)),
    _digit(P.SCOPE, P.RE_CONTRACT, "[A-Z0-9]", needs="-[0-9]{2}-[A-Z]-[0-9]{4}", keywords=P.KW_CONTRACT,
           need_keyword=True),
)


def fold_name(name: str) -> str:
    """Lowercase, every run of non-alphanumerics one space, trimmed."""
    return " ".join(re.findall(r"[a-z0-9]+", name.lower()))


class Registry:
    """An ordered, immutable set of detectors."""

    def __init__(self, detectors: Iterable[Detector] = DEFAULT_DETECTORS):
        self.detectors: tuple[Detector, ...] = tuple(detectors)

    def register(self, *detectors: Detector) -> Registry:
        """A registry that also runs ``detectors``."""
        return Registry((*self.detectors, *detectors))

    def categories(self) -> list[str]:
        """Distinct categories in detector order."""
        return list(dict.fromkeys(d.category for d in self.detectors))

    def normalize(self, names: Sequence[str] | None) -> list[str]:
        """Canonical category names; case and punctuation are forgiven, an
        unknown name is an error, duplicates collapse, order is kept."""
        known = {fold_name(c): c for c in self.categories()}
        found = []
        for name in names or ():
            if fold_name(name) not in known:
                raise ValueError(f"unknown category {name!r} (valid: {', '.join(self.categories())})")
            found.append(known[fold_name(name)])
        return list(dict.fromkeys(found))

    def only(self, names: Sequence[str] | None) -> Registry:
        """The detectors of the named categories (all of them when empty):
        the others are not compiled into the plan at all."""
        wanted = self.normalize(names)
        return Registry(d for d in self.detectors if d.category in wanted) if wanted else self

    def could_match(self, text: Column) -> Column:
        """A filter for right above the file scan: false for documents in
        which no detector fires.  One pass looks for the rare characters all
        matches share; only documents that have one are looked at closer."""
        groups: dict[tuple, list[Detector]] = {}
        for detector in self.detectors:
            groups.setdefault(detector.hint, []).append(detector)
        conditions = [d.could_match(text) for d in groups.pop((), [])]
        if groups:
            close_looks = []
            for hint, members in groups.items():
                closer = any_of([d.could_match(text) for d in members])
                close_looks.append(_hinted(text, hint) & closer if len(members) > 1 else closer)
            pairs = tuple(dict.fromkeys(pair for hint in groups for pair in hint))
            conditions.append(_hinted(text, pairs) & any_of(close_looks))
        return any_of(conditions)


def _hinted(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    characters = "".join(dict.fromkeys(chars for chars, _ in pairs))
    endings = "|".join(f"(?<={ending})" for _, ending in pairs)
    return text.rlike(f"[{characters}](?:{endings})")


DEFAULT = Registry()


def register_detector(detector: Detector, registry: Registry = DEFAULT) -> Registry:
    return registry.register(detector)


def list_categories(spark: SparkSession, registry: Registry = DEFAULT) -> DataFrame:
    """Categories in detector order with their stable slug."""
    from veilscan.functions.scalars import category_slug

    rows = [(pos + 1, name) for pos, name in enumerate(registry.categories())]
    table = spark.createDataFrame(rows, "position int, category string")
    return table.withColumn("category_id", category_slug(F.col("category")))
