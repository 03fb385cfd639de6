"""Texts rendered from the relational tables.

The given documents hold few kinds of personal data, so these queries write
customers and orders out as text first.  Each rendering is one SQL expression
that Spark and DuckDB both understand, over every row of its table.
"""

NL = "chr(10)"


def digits(key: str, factor: int, add: int, width: int) -> str:
    """A number of ``width`` digits that differs from key to key."""
    return f"lpad(cast(({key} * {factor} + {add}) % {10**width} as string), {width}, '0')"


def dashed(number: str, *widths: int, sep: str = "-") -> str:
    """``number`` cut into groups."""
    parts, pos = [], 1
    for width in widths:
        parts.append(f"substr({number}, {pos}, {width})")
        pos += width
    return f" || '{sep}' || ".join(parts)


def text(*lines: str) -> str:
    return f" || {NL} || ".join(f"({line})" for line in lines)


def customer_record(k: str = "c_custkey") -> str:
    ssn = digits(k, 7919, 104729, 9)
    other = digits(k, 611953, 20011, 9)
    card = f"'4' || {digits(k, 15485863, 32452843, 15)}"
    phone = digits(k, 8191, 131071, 10)
    pair = digits(k, 37, 11, 2)
    marking = (
        f"case when {k} % 7 = 0 then 'CUI//SP-PRIV' when {k} % 7 = 1 then 'Header: FCI' "
        f"when {k} % 7 = 2 then 'TLP:AMBER+STRICT' when {k} % 7 = 3 then 'controlled  unclassified information' "
        f"when {k} % 7 = 4 then 'CUIDADO, guitar' when {k} % 7 = 5 then 'marked CUI per DFARS 252.204-7012' "
        "else 'tlp red and TLP:CLEAR' end"
    )
    scope = (
        f"case when {k} % 9 = 0 then 'ITAR: defense articles' when {k} % 9 = 1 then 'plain EAR99 here' "
        f"when {k} % 9 = 2 then 'NIST SP 800-171 Rev 2' when {k} % 9 = 3 then 'see 800-171 controls' "
        f"when {k} % 9 = 4 then 'Distribution Statement D applies' when {k} % 9 = 5 then 'Distribution Statement A' "
        f"when {k} % 9 = 6 then 'Contract No. W91QUZ-18-C-0022' when {k} % 9 = 7 then 'part W91QUZ-18-C-0022 in inventory' "
        "else 'this material is export-controlled' end"
    )
    return text(
        f"'Record é日 ' || cast({k} as string)",
        f"'SSN: ' || {dashed(ssn, 3, 2, 4)} || '  card ' || {dashed(card, 4, 4, 4, 4, sep=' ')} || ' ' || {digits(k, 3, 1, 3)}",
        f"'unlabelled ' || {other}",
        "''",
        f"'order id ' || {ssn}",
        "''",
        f"'employee ssn ' || {other} || ' soc. sec ' || {dashed(ssn, 3, 2, 4, sep=' ')}",
        "''",
        f"'taxpayer ITIN 9' || {dashed(digits(k, 611953, 7, 8), 2, 2, 4)}",
        "''",
        f"'call (' || substr({phone}, 1, 3) || ') ' || {dashed(digits(k, 8191, 7, 7), 3, 4)}",
        "''",
        f"'ref ' || {dashed(phone, 3, 3, 4)} || ' é, mail ' || lower(c_mktsegment) || cast({k} as string) || '@dept'"
        f" || cast({k} % 5 as string) || '.example.com'",
        "''",
        f"'driver license D' || {digits(k, 104729, 3, 8)} || ' passport ' || {other}",
        "''",
        f"'routing number ' || {ssn} || ' account number 000' || {other}",
        "''",
        f"'beneficiary 1EG4-TE5-MK' || {pair} || ' patient mrn ' || {digits(k, 31, 8675309, 7)} || ' dx E11.' || {pair}",
        "''",
        f"'1EG4TE5MK' || {pair} || ' E11.' || {pair} || ' 日本 '",
        "''",
        marking,
        "''",
        scope,
        "''",
        f"'cards ' || {dashed(card, 4, 4, 4, 4)} || ' ' || {dashed(card, 4, 4, 4, 4)} || ' 12/26, 4111 1111 1111 1111 ' || {pair}",
    )


def order_record(k: str = "o_orderkey") -> str:
    month = "lpad(cast(month(o_orderdate) as string), 2, '0')"
    day = "lpad(cast(day(o_orderdate) as string), 2, '0')"
    year = "cast(year(o_orderdate) as string)"
    return (
        f"case when {k} % 4 = 0 then 'date of birth: ' || {month} || '/' || {day} || '/' || {year}"
        f" when {k} % 4 = 1 then 'invoice date ' || {month} || '/' || {day} || '/' || {year}"
        f" when {k} % 4 = 2 then 'DOB ' || {year} || '-' || {month} || '-' || {day} || ' / born March 3rd, ' || {year}"
        f" else 'born ' || {NL} || 'Sept. ' || {day} || ' ' || {year} end"
        f" || {NL} || 'order ' || cast({k} as string) || ' ' || o_orderpriority"
    )


def paged_record(k: str = "c_custkey") -> str:
    """Pages joined by form feeds."""
    ssn = dashed(digits(k, 7919, 104729, 9), 3, 2, 4)
    return (
        f"'cover' || {NL} || 'ssn ' || {ssn} || {NL} || 'end' || chr(12) || 'page two' || {NL} || 'x ' || {ssn}"
        f" || {NL} || chr(12) || case when {k} % 3 = 0 then chr(12) else 'last' || {NL} end || {ssn}"
    )


def credential_file(k: str = "c_custkey") -> str:
    """A password export; some passwords are too short to count."""
    return text(
        "'url,username,password'",
        f"'a.example,' || lower(c_mktsegment) || '@example.com,\"p,w' || cast({k} as string) || '\"'",
        "'b.example,user,ab'",
        f"'c.example,call 412-823-0629,' || {digits(k, 7919, 17, 6)}",
    )


def mime_message(k: str = "c_custkey") -> str:
    """A plain message with a text attachment."""
    ssn = dashed(digits(k, 7919, 104729, 9), 3, 2, 4)
    eol = "chr(13) || chr(10)"
    lines = [
        f"'From: HR Desk <hr' || cast({k} as string) || '@example.com>'",
        "'To: team@example.com'",
        f"'Subject: Form ' || cast({k} as string)",
        "'Date: Wed, 08 Oct 2025 09:15:00 -0400'",
        "'MIME-Version: 1.0'",
        "'Content-Type: multipart/mixed; boundary=\"b\"'",
        "''",
        "'--b'",
        "'Content-Type: text/plain'",
        "''",
        f"'Her SSN is ' || {ssn} || '.'",
        "'--b'",
        "'Content-Type: text/csv; name=\"list.csv\"'",
        "'Content-Disposition: attachment; filename=\"list.csv\"'",
        "''",
        "'name,phone'",
        f"'Ann,412-823-' || {digits(k, 7, 11, 4)}",
        "'--b--'",
        "''",
    ]
    return f" || {eol} || ".join(f"({line})" for line in lines)


def file_path(k: str = "c_custkey") -> str:
    """A path whose name and folders exercise the file rules."""
    folder = (
        f"case when {k} % 11 = 0 then '/AppData/Local' when {k} % 11 = 1 then '/node_modules/pkg'"
        f" when {k} % 11 = 2 then '/Backups' when {k} % 11 = 3 then '/.git' else '/team' || cast({k} % 4 as string) end"
    )
    name = (
        f"case when {k} % 13 = 0 then '.docx' when {k} % 13 = 1 then '.PDF' when {k} % 13 = 2 then '.png'"
        f" when {k} % 13 = 3 then '.doc' when {k} % 13 = 4 then '.zip' when {k} % 13 = 5 then '.txt'"
        f" when {k} % 13 = 6 then '.pst' when {k} % 13 = 7 then '' when {k} % 13 = 8 then '.XLSM'"
        f" when {k} % 13 = 9 then '.olk15MsgSource' when {k} % 13 = 10 then '.csv' when {k} % 13 = 11 then '.bak'"
        " else '.py' end"
    )
    return f"'/share/' || c_mktsegment || {folder} || '/f' || cast({k} as string) || {name}"
