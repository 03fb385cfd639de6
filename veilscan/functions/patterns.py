r"""Detection rules: fixed values, written in RE2 syntax.

``\b`` is an ASCII word boundary, ``\s`` is ``[\t\n\f\r ]`` and ``(?i)`` folds
the long s and the Kelvin sign as well.  :mod:`veilscan.functions.regex` turns
each pattern into the Java form Spark evaluates; DuckDB takes them as they are.
"""

# --- fixed values: category names -------------------------------------------
SSN = "SSN"
ITIN = "ITIN"
CREDIT_CARD = "Credit Card"
EMAIL = "Email Address"
PHONE = "Phone Number"
DATE_OF_BIRTH = "Date of Birth"
DRIVERS_LICENSE = "Driver's License"
PASSPORT = "Passport Number"
ROUTING = "Bank Routing Number"
ACCOUNT = "Bank Account Number"
MEDICARE = "Medicare ID (HIPAA)"
MEDICAL_RECORD = "Medical Record Number (HIPAA)"
DIAGNOSIS = "Diagnosis Code (HIPAA)"
MARKING = "Document Marking (CMMC)"
SCOPE = "Scope Indicator (CMMC)"

# --- fixed values: context keywords -----------------------------------------
KW_SSN = r"(?i)\b(ssn|soc(ial)?[\s.-]*sec|tax\s*id|tin)\b"
KW_DOB = r"(?i)\b(dob|date\s*of\s*birth|birth\s*date|born)\b"
KW_LICENSE = (
    r"(?i)(driver'?s?\s*(license|licence|lic)\b|\bdl\s*(#|no\.?|num)"
    r"|\blicense\s*(#|no\.?|number))"
)
KW_PASSPORT = r"(?i)\bpassport\b"
KW_ROUTING = r"(?i)\b(routing|aba|rtn)\b"
KW_ACCOUNT = (
    r"(?i)((bank|checking|savings)\s+account"
    r"|\b(account|acct)\.?\s*(number|no\.?|num|#))"
)
KW_PHONE = r"(?i)\b(phone|tel(ephone)?|mobile|cell|fax|call)\b"
KW_MEDICARE = r"(?i)\b(medicare|mbi|beneficiary)\b"
KW_MEDICAL_RECORD = r"(?i)\b(mrn|medical\s*record|patient\s*(id|no\.?|number))\b"
KW_DIAGNOSIS = r"(?i)(diagnos|icd[- ]?10|icd[- ]?9|\bdx\b)"
KW_MARKING = (
    r"(?i)(controlled\s+unclassified|federal\s+contract|cui\s*//|\bcontrolled\b"
    r"|dissemination|distribution\s+statement|\bdfars\b|800[-\s]?171|\bcmmc\b"
    r"|\bnoforn\b|\bfouo\b|export[-\s]controlled|\bitar\b)"
)
KW_EXPORT = (
    r"(?i)(export|munitions|defense\s+article|\busml\b|arms\s+regulations"
    r"|commerce\s+control|technical\s+data)"
)
KW_NIST = r"(?i)(\bnist\b|\bsp\b|\brev(ision)?\b|assessment|compliance|\bdfars\b|\bcmmc\b)"
KW_CONTRACT = (
    r"(?i)\b(contract|award|task\s+order|delivery\s+order|solicitation"
    r"|procurement|\bdfars\b|\bcage\b)"
)

# the letters and digits with which matches of a keyword rule begin
KEYWORD_STARTS = {
    KW_SSN: "st",
    KW_DOB: "db",
    KW_LICENSE: "dl",
    KW_PASSPORT: "p",
    KW_ROUTING: "ra",
    KW_ACCOUNT: "bcsa",
    KW_PHONE: "ptmcf",
    KW_MEDICARE: "mb",
    KW_MEDICAL_RECORD: "mp",
    KW_DIAGNOSIS: "di",
    KW_MARKING: "cfd8nei",
    KW_EXPORT: "emduact",
    KW_NIST: "nsracd",
    KW_CONTRACT: "catdsp",
}

# --- fixed values: identifier shapes ----------------------------------------
RE_SSN_DASHED = r"\b(\d{3})-(\d{2})-(\d{4})\b"
RE_SSN_BARE = r"\b(\d{3})(\d{2})(\d{4})\b"
RE_SSN_SPACED = r"\b(\d{3}) (\d{2}) (\d{4})\b"
RE_ITIN = r"\b(9\d{2})-(\d{2})-(\d{4})\b"
RE_CARD = r"\b(?:\d[ -]?){12,18}\d\b"
RE_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
RE_PHONE = r"(?:\+?1[-. ]?)?\(?\b\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b"
RE_DATE = (
    r"(?i)\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?"
    r"|sep(t(ember)?)?|oct(ober)?|nov(ember)?|dec(ember)?)\.?\s+\d{1,2}"
    r"(st|nd|rd|th)?,?\s+\d{4}\b"
)
RE_LICENSE = r"\b(?:[A-Za-z]{1,2}[- ]?\d{4,12}|\d{5,12})\b"
RE_PASSPORT = r"\b[A-Za-z]?\d{8,9}\b"
RE_ROUTING = r"\b(\d{9})\b"
RE_ACCOUNT = r"\b\d{6,17}\b"
RE_MEDICARE = (
    r"\b[1-9][AC-HJ-KM-NP-RT-Y][AC-HJ-KM-NP-RT-Y0-9]\d-?"
    r"[AC-HJ-KM-NP-RT-Y][AC-HJ-KM-NP-RT-Y0-9]\d-?"
    r"[AC-HJ-KM-NP-RT-Y][AC-HJ-KM-NP-RT-Y]\d{2}\b"
)
RE_MEDICAL_RECORD = r"\b\d{5,10}\b"
RE_DIAGNOSIS = r"\b[A-TV-Z]\d{2}\.\d{1,4}\b"
RE_MARKING_PHRASE = (
    r"(?i)\b(controlled\s+unclassified\s+information"
    r"|federal\s+contract\s+information)\b"
)
RE_CUI = r"\bCUI(?://[A-Z0-9/+=\-]+)?\b"
RE_FCI = r"\bFCI\b"
RE_TLP = r"(?i)\bTLP\s*[:\s-]\s*(RED|AMBER(?:\+\s*STRICT)?|GREEN)\b"
RE_EXPORT_PHRASE = (
    r"(?i)\b(international\s+traffic\s+in\s+arms\s+regulations"
    r"|export\s+administration\s+regulations|export[-\s]controlled"
    r"|distribution\s+statement\s+[B-F])\b"
)
RE_EXPORT_ACRONYM = r"\b(ITAR|EAR99)\b"
RE_DFARS = r"\b252\.204-70\d{2}\b"
RE_NIST = r"\b800-171[Aa]?\b"
RE_CONTRACT = r"\b[A-Z0-9]{6}-\d{2}-[A-Z]-\d{4}\b"
