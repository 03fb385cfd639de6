"""The registered queries and their SQL twins, side by side.

Every query runs over whole tables: the text columns as given, or customers
and orders written out as text (:mod:`checks.records`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as O
from checks import records as R
from veilscan.functions import patterns as P
from veilscan.functions import scalars as S
from veilscan.functions import sql
from veilscan.functions import validators as V
from veilscan.functions.storage import ensure_checkpoint_dir, materialize, spread
from veilscan.operators import alerts, detectors, events, filters, masking, rollup
from veilscan.operators.masking import mask_array, mask_findings
from veilscan.operators.scan import scan_table
from veilscan.plans.mail_scan import scan_messages
from veilscan.sources import credentials, files, mail, reports
from veilscan.streaming import watch
from veilscan.streaming.stream import scan_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = "timestamp '2024-02-05 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


# --- texts ---------------------------------------------------------------------


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html")


def customers(spark, sf, text: str | None = None):
    text = R.customer_record() if text is None else text
    return spread(table(spark, sf, "customer")).select("c_custkey", F.expr(text).alias("text"))


def orders(spark, sf):
    return spread(table(spark, sf, "orders")).select("o_orderkey", F.expr(R.order_record()).alias("text"))


SHOWN = ("doc_id", "category", "confidence", "line", "match", "start_at", "end_at")
SHOWN_SQL = (
    'select id as doc_id, category, confidence, line, "match", s as start_at, e as end_at from found'
)


def shown(findings: DataFrame) -> DataFrame:
    return findings.withColumnsRenamed({"start": "start_at", "end": "end_at"}).select(*SHOWN)


def _detector_query(name: str, category: str, source: str) -> None:
    sources = {
        "documents": (documents, "doc_id", "documents", "text"),
        "customers": (customers, "c_custkey", "customer", R.customer_record()),
        "orders": (orders, "o_orderkey", "orders", R.order_record()),
    }
    read, key, relation, text = sources[source]

    @query(name, O.detection(relation, key, text, [category]) + " " + SHOWN_SQL)
    def run(spark, sf):
        return shown(scan_table(read(spark, sf), key, "text", categories=[category]))


for _name, _category, _source in (
    ("detect_credit_card", P.CREDIT_CARD, "documents"),
    ("detect_email", P.EMAIL, "documents"),
    ("detect_phone", P.PHONE, "documents"),
    ("detect_card_runs", P.CREDIT_CARD, "customers"),
    ("detect_phone_keywords", P.PHONE, "customers"),
    ("detect_ssn", P.SSN, "customers"),
    ("detect_itin", P.ITIN, "customers"),
    ("detect_dob", P.DATE_OF_BIRTH, "orders"),
    ("detect_drivers_license", P.DRIVERS_LICENSE, "customers"),
    ("detect_passport", P.PASSPORT, "customers"),
    ("detect_routing", P.ROUTING, "customers"),
    ("detect_account", P.ACCOUNT, "customers"),
    ("detect_medicare", P.MEDICARE, "customers"),
    ("detect_mrn", P.MEDICAL_RECORD, "customers"),
    ("detect_diagnosis", P.DIAGNOSIS, "customers"),
    ("detect_marking", P.MARKING, "customers"),
    ("detect_scope", P.SCOPE, "customers"),
):
    _detector_query(_name, _category, _source)

DOC = O.detection("documents", "doc_id", "text")
CUST = O.detection("customer", "c_custkey", R.customer_record())


def doc_findings(spark, sf, **kw):
    return scan_table(documents(spark, sf), "doc_id", "text", **kw)


def customer_findings(spark, sf, **kw):
    return scan_table(customers(spark, sf), "c_custkey", "text", **kw)


@query("category_counts", DOC + ' select category, count(*) as "count" from found group by category')
def category_counts(spark, sf):
    return rollup.category_counts(doc_findings(spark, sf))


@query("scan_documents", DOC + " " + SHOWN_SQL)
def scan_documents(spark, sf):
    return shown(doc_findings(spark, sf))


@query("scan_pages", O.detection("pages", "page_id", "html") + " " + SHOWN_SQL)
def scan_pages(spark, sf):
    return shown(scan_table(pages(spark, sf), "page_id", "html"))


# every turn also tells a number, so that there is something to find
_TURN = f"text || ' SSN ' || {R.dashed(R.digits('(conv_id + 131 * turn)', 7919013, 104729, 9), 3, 2, 4)}"


@query(
    "scan_conversations",
    O.detection("conversations", "conv_id || '-' || turn", _TURN) + " " + SHOWN_SQL,
)
def scan_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.expr(_TURN).alias("text")
    )
    return shown(scan_table(turns, "turn_id", "text"))


@query("spans_dedupe", CUST + " " + SHOWN_SQL)
def spans_dedupe(spark, sf):
    return shown(customer_findings(spark, sf))


@query("min_confidence", CUST + " " + SHOWN_SQL + " where confidence = 'high'")
def min_confidence(spark, sf):
    return shown(customer_findings(spark, sf, min_confidence="high"))


@query("category_filter", O.detection("customer", "c_custkey", R.customer_record(), ["passport-number", "Bank account NUMBER"]) + " " + SHOWN_SQL)
def category_filter(spark, sf):
    return shown(customer_findings(spark, sf, categories=["passport-number", "Bank account NUMBER"]))


@query(
    "exclude_emails",
    CUST + " " + SHOWN_SQL + """ where not (category = 'Email Address' and (lower("match") like '%@dept1.example.com'
    or lower("match") like '%@dept2.example.com' or lower("match") = 'building4@dept4.example.com'))""",
)
def exclude_emails(spark, sf):
    return shown(
        customer_findings(
            spark, sf, exclude_emails=["*@DEPT1.example.com, dept2.example.com", "building4@dept4.example.com", "example.com"]
        )
    )


@query(
    "filter_findings",
    CUST + """ , f as (select *, lower(concat_ws(' ', id, category, confidence, line, "match", context)) as row_text from found)
    select id as doc_id, category, confidence, line, "match", s as start_at, e as end_at from f
    where contains(row_text, 'mail house') and category = 'Email Address'""",
)
def filter_findings(spark, sf):
    return shown(
        filters.filter_findings(
            customer_findings(spark, sf), text="MAIL House", category=P.EMAIL, confidence="medium"
        )
    )


_CONTEXT = 'select id as doc_id, s as start_at, e as end_at, category, context from found'


@query("context_snippet", CUST + " " + _CONTEXT)
def context_snippet(spark, sf):
    found = customer_findings(spark, sf).withColumnsRenamed({"start": "start_at", "end": "end_at"})
    return found.select("doc_id", "start_at", "end_at", "category", "context")


@query("context_documents", DOC + " " + _CONTEXT)
def context_documents(spark, sf):
    found = doc_findings(spark, sf).withColumnsRenamed({"start": "start_at", "end": "end_at"})
    return found.select("doc_id", "start_at", "end_at", "category", "context")


@query(
    "locate_pages",
    O.detection("customer", "c_custkey", R.paged_record(), paged=True)
    + ' select id as doc_id, category, line, page, "match", s as start_at from found',
)
def locate_pages(spark, sf):
    found = scan_table(customers(spark, sf, R.paged_record()), "c_custkey", "text", ocr=F.lit(True))
    return found.withColumnRenamed("start", "start_at").select("doc_id", "category", "line", "page", "match", "start_at")


_MASKED = f"""select id as doc_id, category, line, case when {O.plain()} then "match" else {O.mask('"match"')} end as "match",
 c as context, s as start_at from masked_ctx"""


def _masked_columns(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("start", "start_at").select(
        "doc_id", "category", "line", "match", "context", "start_at"
    )


@query("mask_documents", DOC + O.masked() + _MASKED)
def mask_documents(spark, sf):
    return _masked_columns(doc_findings(spark, sf, transform_findings=mask_array))


@query("mask_records", CUST + O.masked() + _MASKED)
def mask_records(spark, sf):
    return _masked_columns(customer_findings(spark, sf, transform_findings=mask_array))


@query("mask_findings", CUST + O.masked() + _MASKED)
def mask_findings_table(spark, sf):
    return _masked_columns(mask_findings(customer_findings(spark, sf)))


_VALUES = f"""select k as order_key, phone, {O.mask('phone')} as masked_phone, {O.mask('email')} as masked_email, {O.mask('odd')} as masked_odd
from (select o_orderkey as k, '412-823-' || {R.digits('o_orderkey', 7, 3, 4)} as phone,
 'é' || lower(o_orderpriority) || cast(o_orderkey as varchar) || '@x.org' as email,
 '@' || o_orderpriority || ' #' || cast(o_custkey as varchar) as odd from orders)"""


@query("mask_values", _VALUES)
def mask_values(spark, sf):
    k = F.col("o_orderkey")
    values = table(spark, sf, "orders").select(
        k.alias("order_key"),
        F.expr(f"'412-823-' || {R.digits('o_orderkey', 7, 3, 4)}").alias("phone"),
        F.concat(F.lit("é"), F.lower("o_orderpriority"), k.cast("string"), F.lit("@x.org")).alias("email"),
        F.concat(F.lit("@"), "o_orderpriority", F.lit(" #"), F.col("o_custkey").cast("string")).alias("odd"),
    )
    return values.select(
        "order_key",
        "phone",
        S.mask(F.col("phone")).alias("masked_phone"),
        S.mask(F.col("email")).alias("masked_email"),
        S.mask(F.col("odd")).alias("masked_odd"),
    )


@query(
    "mask_from",
    f"""select c_custkey, case when c_custkey % 3 = 0 then c_name || ' <' || {O.mask("addr")} || '>' when c_custkey % 3 = 1 then {O.mask("addr")}
    else c_name end as sender from (select *, lower(c_mktsegment) || '.' || cast(c_custkey as varchar) || '@example.com' as addr from customer)""",
)
def mask_from(spark, sf):
    address = F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    sender = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" <"), address, F.lit(">")))
        .when(F.col("c_custkey") % 3 == 1, address)
        .otherwise(F.col("c_name"))
    )
    return table(spark, sf, "customer").select("c_custkey", S.mask_from(sender).alias("sender"))


_CELL = "substr('=+-@x' || chr(9) || chr(13), cast(l_linenumber % 7 + 1 as int), 1) || cast(l_orderkey as string) || '=|' || chr(10) || l_returnflag"


@query("csv_safe", f"select l_orderkey, l_linenumber, {O.csv_safe('cell')} as cell from (select *, {_CELL} as cell from lineitem)")
def csv_safe(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.csv_safe(F.expr(_CELL)).alias("cell"))


@query(
    "cef_escapes",
    f"""select p_partkey, replace(replace(v, '\\', '\\\\'), '|', '\\|') as header, {O.cef_ext('v')} as ext
    from (select p_partkey, p_name || '|' || chr(92) || p_brand || '=' || chr(10) || p_type || chr(13) as v from part)""",
)
def cef_escapes(spark, sf):
    value = F.concat(
        "p_name", F.lit("|"), F.lit("\\"), "p_brand", F.lit("="), F.lit("\n"), "p_type", F.lit("\r")
    )
    return table(spark, sf, "part").select(
        "p_partkey", S.cef_escape_header(value).alias("header"), S.cef_escape_ext(value).alias("ext")
    )


@query(
    "text_scalars",
    f"""select p_partkey, {O.slug('v')} as slug, trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) as folded,
    trim(regexp_replace(v, '\\s+', ' ', 'g')) as flat, string_split(v, '/')[-1] as base
    from (select p_partkey, ' (' || p_brand || ')' || chr(10) || chr(9) || p_type || '/' || p_name || ' ' as v from part)""",
)
def text_scalars(spark, sf):
    v = F.concat(F.lit(" ("), "p_brand", F.lit(")\n\t"), "p_type", F.lit("/"), "p_name", F.lit(" "))
    return table(spark, sf, "part").select(
        "p_partkey",
        S.category_slug(v).alias("slug"),
        S.fold_category(v).alias("folded"),
        S.one_line(v).alias("flat"),
        S.file_name(v).alias("base"),
    )


@query(
    "event_scalars",
    f"""select event_id, case when age < 3600 then cast(age // 60 as varchar) || ' min' when age < 172800 then cast(age // 3600 as varchar) || ' h'
    else cast(age // 86400 as varchar) || ' days' end as age, strftime(ts, '%Y-%m-%d %H:%M') as mail_date,
    case level when 'high' then 8 when 'medium' then 5 else 3 end as severity,
    case level when 'high' then 132 when 'medium' then 133 else 134 end as priority
    from (select *, cast(epoch({NOW}) - floor(epoch(ts)) as bigint) as age,
    case event_type when 'error' then 'high' when 'click' then 'medium' else 'low' end as level from events)""",
)
def event_scalars(spark, sf):
    age = F.unix_timestamp(F.expr(NOW)) - F.unix_timestamp("ts")
    level = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    return table(spark, sf, "events").select(
        "event_id",
        S.rough_age(age).alias("age"),
        S.mail_date(F.col("ts")).alias("mail_date"),
        S.cef_severity(level).alias("severity"),
        S.syslog_priority(level).alias("priority"),
    )


_N9, _N15 = R.digits("o_orderkey", 7919, 104729, 9), R.digits("o_orderkey", 15485863, 7, 15)


@query(
    "validators",
    f"""select o_orderkey, {O.valid_ssn('n9')} as ssn, {O.valid_itin("substr(n9, 1, 3) || '-' || substr(n9, 4, 6)")} as itin,
    {O.valid_aba('n9')} as aba, {O.valid_card('card')} as card
    from (select o_orderkey, {_N9} as n9, cast(o_orderkey % 6 + 1 as varchar) || {_N15} as card from orders)""",
)
def validators(spark, sf):
    numbers = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr(_N9).alias("n9"),
        F.expr(f"cast(o_orderkey % 6 + 1 as string) || {_N15}").alias("card"),
    )
    return numbers.select(
        "o_orderkey",
        V.valid_ssn(F.col("n9")).alias("ssn"),
        V.valid_itin(F.col("n9")).alias("itin"),
        V.valid_aba(F.col("n9")).alias("aba"),
        V.valid_card(F.col("card")).alias("card"),
    )


# --- rollups ---------------------------------------------------------------------


@query(
    "document_groups",
    CUST + """ , per as (select id, category, count(*) as n from found group by all),
    totals as (select id, cast(sum(n) as bigint) as total, string_agg(category || '=' || n, ';' order by n desc, category) as categories
        from per group by id)
    select id as path, total, categories,
        string_agg(line || '|' || category || '|' || confidence || '|' || s || '|' || e || '|' || "match" || '|' || context, chr(10)
            order by line, category, s, "match", confidence, context, e) as findings
    from found join totals using (id) group by all""",
)
def document_groups(spark, sf):
    found = customer_findings(spark, sf).drop("doc_id", "file_name", "category_id", "page", "ocr")
    groups = rollup.document_groups(found)
    listed = F.transform("categories", lambda c: F.concat(c["category"], F.lit("="), c["count"].cast("string")))
    shown = F.transform(
        "findings",
        lambda f: F.concat_ws(
            "|", f["line"].cast("string"), f["category"], f["confidence"], f["start"].cast("string"), f["end"].cast("string"),
            f["match"], f["context"],
        ),
    )
    return groups.select(
        "path", "total", F.array_join(listed, ";").alias("categories"), F.array_join(shown, "\n").alias("findings")
    )


_PAGE = 250

# all customers of a market segment as one document: each holds a fifth of all findings
@query(
    "document_pages",
    CUST + f""" , placed as (
        select c_mktsegment as path, found.*,
            row_number() over (partition by c_mktsegment order by line, category, s, "match", confidence, context, id, e) - 1 as spot
        from found join customer on cast(c_custkey as varchar) = id),
    per as (select path, category, count(*) as n from placed group by all),
    totals as (select path, cast(sum(n) as bigint) as total, string_agg(category || '=' || n, ';' order by n desc, category) as categories
        from per group by path)
    select path, cast(spot // {_PAGE} + 1 as int) as page, total, categories, count(*) as held,
        string_agg(id || '|' || line || '|' || category || '|' || s || '|' || "match" || '|' || context, chr(10) order by spot) as findings
    from placed join totals using (path) group by all""",
)
def document_pages(spark, sf):
    named = spread(table(spark, sf, "customer")).select("c_custkey", "c_mktsegment", F.expr(R.customer_record()).alias("text"))
    found = scan_table(named, "c_custkey", "text", path_col="c_mktsegment")
    pages = rollup.document_pages(found.drop("file_name", "category_id", "page", "ocr"), size=_PAGE)
    shown = F.transform(
        "findings",
        lambda f: F.concat_ws("|", f["doc_id"], f["line"].cast("string"), f["category"], f["start"].cast("string"), f["match"], f["context"]),
    )
    listed = F.transform("categories", lambda c: F.concat(c["category"], F.lit("="), c["count"].cast("string")))
    return pages.select(
        "path", "page", "total", F.array_join(listed, ";").alias("categories"),
        F.size("findings").cast("long").alias("held"), F.array_join(shown, "\n").alias("findings"),
    )


@query("files_with_findings", DOC + " select count(distinct id) as files_with_findings from found")
def files_with_findings(spark, sf):
    return rollup.files_with_findings(doc_findings(spark, sf))


@query(
    "document_rank",
    DOC + " select id as path, dense_rank() over (order by id) as document_rank from (select distinct id from found)",
)
def document_rank(spark, sf):
    return rollup.document_rank(doc_findings(spark, sf))


@query("sort_findings", DOC + " " + SHOWN_SQL + " order by id, line, category, s, \"match\"")
def sort_findings(spark, sf):
    return shown(rollup.sort_findings(doc_findings(spark, sf)))


@query(
    "findings_by_source",
    DOC + """ select 'host-' || (cast(id as bigint) % 3) as host, id as path, count(*) as findings,
    count(distinct category) as kinds from found group by all""",
)
def findings_by_source(spark, sf):
    found = doc_findings(spark, sf).withColumn(
        "host", F.concat(F.lit("host-"), (F.col("doc_id").cast("long") % 3).cast("string"))
    )
    groups = rollup.findings_by_source(found)
    return groups.select("host", "path", "findings", F.size("categories").cast("long").alias("kinds"))


@query(
    "needs_ocr",
    """select doc_id, len(regexp_replace(text, '\\s', '', 'g')) < 20 as needs_ocr from documents""",
)
def needs_ocr(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.lacks_text_layer(F.col("text")).alias("needs_ocr"))


_EXT = "lower(regexp_extract(string_split(path, '/')[-1], '\\.[^.]*$'))"
_KIND_SQL = f"""case when {_EXT} in ('.pst', '.ost', '.olk15msgsource', '.olk14msgsource') then 'mail_store'
 when {_EXT} = '.docx' then 'docx' when {_EXT} in ('.xlsx', '.xlsm') then 'xlsx' when {_EXT} = '.pptx' then 'pptx'
 when {_EXT} = '.pdf' then 'pdf' when {_EXT} = '.png' then 'image' when {_EXT} = '.doc' then 'unreadable_doc'
 when {_EXT} = '.zip' then 'binary' when {_EXT} in ('.txt', '.csv') then 'text' else 'sniff' end"""
_PATHS = f"(select {R.file_path()} as path, c_custkey from customer)"


def paths(spark, sf):
    return table(spark, sf, "customer").select(F.expr(R.file_path()).alias("path"), "c_custkey")


@query("classify_file", f"select path, {_KIND_SQL} as kind from {_PATHS}")
def classify_file(spark, sf):
    return paths(spark, sf).select("path", files.classify_file(F.col("path")).alias("kind"))


@query(
    "exclude_paths",
    f"""select path, regexp_matches(path, '[.]bak$') or contains(lower(path), 'f13') as excluded from {_PATHS}
    where not regexp_matches(path, '/(AppData|node_modules|Backups|[.]git)/')""",
)
def exclude_paths(spark, sf):
    return files.exclude_paths(
        paths(spark, sf).select("path"), ["*.BAK", "back*", "f13", " "], ["/share", "/share/none"]
    ).select("path", "excluded")


def _coverage(spark, sf):
    kind = F.col("kind")
    return paths(spark, sf).withColumn("kind", files.classify_file(F.col("path"))).select(
        "path",
        rollup.coverage_status(
            error=(kind == "sniff") & (F.col("c_custkey") % 2 == 0),
            needs_ocr=kind == "pdf",
            mail_store=kind == "mail_store",
            unreadable_doc=kind == "unreadable_doc",
            skipped=kind.isin("image", "binary"),
        ).alias("status"),
        F.when((kind == "sniff") & (F.col("c_custkey") % 2 == 0), F.lit("bad\n file")).alias("error"),
        (kind == "docx").alias("ocr"),
        F.when(kind == "text", F.lit(2)).otherwise(F.lit(0)).alias("attachments"),
    )


_COVERAGE = f"""cov as (select path, case when kind = 'sniff' and c_custkey % 2 = 0 then 'error' when kind = 'pdf' then 'needs_ocr'
 when kind = 'mail_store' then 'mail_store' when kind = 'unreadable_doc' then 'unreadable_doc' when kind in ('image', 'binary') then 'skipped'
 else 'scanned' end as status, kind = 'docx' as ocr, case when kind = 'text' then 2 else 0 end as attachments
 from (select *, {_KIND_SQL} as kind from {_PATHS}))"""
_STATS = """count(*) filter (status = 'scanned') as files_scanned,
 count(*) filter (status = 'scanned' and ocr) as files_ocr, count(*) filter (status = 'skipped') as files_skipped,
 count(*) filter (status = 'needs_ocr') as files_need_ocr, count(*) filter (status = 'cloud') as files_cloud_skipped,
 count(*) filter (status = 'mail_store') as files_mail_skipped, count(*) filter (status = 'unreadable_doc') as files_unreadable_docs,
 count(*) filter (status = 'error') as files_errored, cast(sum(attachments) filter (status = 'scanned') as bigint) as attachments_scanned"""


@query("coverage_stats", f"with {_COVERAGE} select {_STATS} from cov")
def coverage_stats(spark, sf):
    return rollup.coverage_stats(_coverage(spark, sf))


@query(
    "coverage_lists",
    f"""with {_COVERAGE} select distinct status as gap, case when status = 'error' then path || ': bad file'
    when lower(path) like '%.olk15msgsource' then regexp_replace(path, '/[^/]*$', '') else path end as entry
    from cov where status in ('error', 'needs_ocr', 'mail_store', 'unreadable_doc')""",
)
def coverage_lists(spark, sf):
    return rollup.coverage_lists(_coverage(spark, sf))


@query(
    "top_gaps",
    f"""with {_COVERAGE} select path, (select count(*) - 10 from cov where status = 'needs_ocr') as more
    from cov where status = 'needs_ocr' order by path limit 10""",
)
def top_gaps(spark, sf):
    return rollup.top_gaps(_coverage(spark, sf).where(F.col("status") == "needs_ocr").select("path"))


@query(
    "run_summary",
    "with recursive " + _COVERAGE + ", " + CUST.removeprefix("with recursive ")
    + f""" select '/share' as roots, '4.2s' as duration, true as masked, (select count(*) from found) as findings,
    {_STATS} from cov""",
)
def run_summary(spark, sf):
    summary = rollup.run_summary(
        customer_findings(spark, sf), _coverage(spark, sf), roots=["/share"], duration="4.2s"
    )
    return summary.withColumn("roots", F.array_join("roots", ",")).drop("mail_roots")


# --- events ----------------------------------------------------------------------


def scan_log(spark, sf):
    """The given events read as a log: errors stand for summaries."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
        F.when(F.col("event_type") == "error", "scan_summary").otherwise("finding").alias("event"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("findings"),
    )


_LOG = """(select 'host-' || user_id as host, case when event_type = 'error' then 'scan_summary' else 'finding' end as event,
 ts as "timestamp", event_id as findings from events)"""
_LAST = f"""(select host, max("timestamp") as "timestamp", max_by(findings, "timestamp") as findings from {_LOG}
 where event = 'scan_summary' group by host)"""


@query("last_scan", f"select host, \"timestamp\", findings from {_LAST}")
def last_scan(spark, sf):
    return rollup.last_scan(scan_log(spark, sf)).select("host", "timestamp", "findings")


@query(
    "stale_scans",
    f"""select host, "timestamp", findings, cast(age // 86400 as varchar) || ' days' as age from
    (select *, cast(epoch({NOW}) - floor(epoch("timestamp")) as bigint) as age from {_LAST}) where age > 777600""",
)
def stale_scans(spark, sf):
    return rollup.stale_scans(scan_log(spark, sf), F.expr(NOW)).select("host", "timestamp", "findings", "age")


@query(
    "silent_hosts",
    f"""select distinct host from (select 'host-' || user_id as host from events union select 'host-new-' || s_suppkey from supplier)
    where host not in (select host from {_LOG} where event = 'scan_summary'
    and epoch({NOW}) - floor(epoch("timestamp")) <= 777600)""",
)
def silent_hosts(spark, sf):
    known = scan_log(spark, sf).select("host").union(
        table(spark, sf, "supplier").select(F.concat(F.lit("host-new-"), F.col("s_suppkey").cast("string")))
    )
    return rollup.silent_hosts(known.distinct(), scan_log(spark, sf), F.expr(NOW))


def _mail_columns(found: DataFrame) -> DataFrame:
    """Mail fields for every other document."""
    n = F.col("doc_id").cast("long")
    return found.withColumns(
        {
            "folder": F.when(n % 2 == 0, F.lit("Inbox")),
            "subject": F.when(n % 2 == 0, F.concat(F.lit("Re=port "), "doc_id")),
            "from": F.when(n % 2 == 0, F.lit("HR <h*@x.com>")),
            "date": F.when(n % 2 == 0, F.lit("2026-10-07 09:15")),
            "attachment": F.when(n % 4 == 0, F.lit("w4.pdf")),
            "ocr": F.when(n % 3 == 0, F.lit(True)),
        }
    )


_MAIL = """, ev as (select *, id as path, id as file_name, cast(id as bigint) as n,
 case when cast(id as bigint) % 2 = 0 then 'Inbox' end as folder, case when cast(id as bigint) % 2 = 0 then 'Re=port ' || id end as subject,
 case when cast(id as bigint) % 2 = 0 then 'HR <h*@x.com>' end as "from", case when cast(id as bigint) % 2 = 0 then '2026-10-07 09:15' end as date,
 case when cast(id as bigint) % 4 = 0 then 'w4.pdf' end as attachment, case when cast(id as bigint) % 3 = 0 then true end as ocr from found)"""


def _cef_sql() -> str:
    def e(x: str) -> str:
        return O.cef_ext(f"coalesce({x}, '')")

    return f"""'CEF:0|example|pii-scan|1.0|' || {O.slug('category')} || '|PII detected: ' || category || '|' ||
 case confidence when 'high' then '8' when 'medium' then '5' else '3' end || '|filePath=' || {e('path')} || ' fname=' || {e('file_name')}
 || ' cn1Label=lineNumber cn1=' || line || ' cs1Label=category cs1=' || {e('category')} || ' cs2Label=confidence cs2=' || {e('confidence')}
 || ' cs3Label=match cs3=' || {e('"match"')} || case when folder is not null then ' cs4Label=mailFolder cs4=' || {e('folder')} ||
 ' cs5Label=mailSubject cs5=' || {e('subject')} || ' cs6Label=mailDate cs6=' || {e('date')} || ' suser=' || {e('"from"')} ||
 ' flexString1Label=attachment flexString1=' || {e('attachment')} else '' end || ' msg=' || {e('context')}"""


@query("to_cef", CUST + _MAIL + f" select id as doc_id, s as start_at, category, {_cef_sql()} as cef from ev")
def to_cef(spark, sf):
    found = _mail_columns(customer_findings(spark, sf))
    return found.select("doc_id", F.col("start").alias("start_at"), "category", events.to_cef(found).alias("cef"))


_GAP = "'/scans/a=b|' || c_custkey || '.pdf'"
_RUNS = {
    "findings": "count(*)",
    "files_scanned": "count(case when c_acctbal > 0 then 1 end)",
    "files_need_ocr": "count(case when c_custkey % 7 = 0 then 1 end)",
    "files_errored": "count(case when c_custkey % 3 = 0 then 1 end)",
}

# every kind of event (findings, documents without text, a summary for each nation) in every form of a line
@query(
    "parse_cef",
    CUST + _MAIL + f""" , runs as (select c_nationkey, {', '.join(f'{n} as {name}' for name, n in _RUNS.items())} from customer group by c_nationkey),
    every as (
        select n % 5 >= 3 as js, 'finding' as event, case confidence when 'high' then 8 when 'medium' then 5 else 3 end as severity,
            path, file_name, category, {O.slug('category')} as category_id, confidence, line, "match", context, ocr, folder, subject, date, "from",
            attachment, cast(null as varchar) as duration, cast(null as bigint) as findings, cast(null as bigint) as files_scanned,
            cast(null as bigint) as files_need_ocr, cast(null as bigint) as files_errored, true as masked from ev
        union all select c_custkey % 5 >= 3, 'needs_ocr', 5, {_GAP}, 'a=b|' || c_custkey || '.pdf', null, null, null, null, null,
            '{events.NOT_SEARCHED}', null, null, null, null, null, null, null, null, null, null, null, null from customer where c_custkey % 7 = 0
        union all select findings % 5 >= 3, 'scan_summary', 3, null, null, null, null, null, null, null,
            'roots: /home, /n=' || c_nationkey || '; duration 4.2s; skipped 0; cloud-skipped 0; mail-stores-skipped 0; unreadable-docs 0; unreadable '
            || files_errored, null, null, null, null, null, null, '4.2s', findings, files_scanned, files_need_ocr, files_errored, true from runs)
    select event, 'pii-scan' as tool, '1.0' as version, case when not js then severity end as severity, case when js then 'h1' end as host,
    case when js then '2024-02-05T00:00:00Z' end as "timestamp", case when js then masked end as masked, path, file_name, category, category_id,
    confidence, line, "match", case when event = 'finding' or not js then context end as context, case when js then ocr end as ocr, folder, subject,
    date, "from", case when js then attachment when folder is not null then coalesce(attachment, '') end as attachment,
    case when js then duration end as duration, findings, files_scanned, files_need_ocr, case when js then files_errored end as files_errored
    from every""",
)
def parse_cef(spark, sf):
    now, host = F.expr(NOW), F.lit("h1")

    def lines(written, cef, confidence, n):
        form = n % 5
        payload = F.when(form < 3, cef).otherwise(events.event_json(written))
        header = F.when(form == 0, F.lit("")).when(form.isin(1, 3), events.syslog_header(now, host))
        framed = header.otherwise(events.syslog_frame(F.lit(""), confidence, now, host))
        return written.select(F.concat(framed, payload).alias("value"))

    found = events.to_events(_mail_columns(customer_findings(spark, sf)), now, host)
    customer, none = table(spark, sf, "customer"), F.lit(0).cast("long")
    gaps = customer.where("c_custkey % 7 = 0").select(F.expr(_GAP).alias("path"), "c_custkey")
    gaps = events.needs_ocr_events(gaps, now, host)
    counted = customer.groupBy("c_nationkey").agg(*[F.expr(f"{count} as {name}") for name, count in _RUNS.items()])
    summary = counted.select(
        "*",
        F.array(F.lit("/home"), F.concat(F.lit("/n="), F.col("c_nationkey").cast("string"))).alias("roots"),
        F.lit("4.2s").alias("duration"), F.lit(True).alias("masked"), F.lit(None).cast("array<string>").alias("mail_roots"),
        *[none.alias(c) for c in events.SUMMARY_COUNTERS if c not in counted.columns],
    )
    summary = events.summary_event(summary, now, host)
    key = F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long")
    every = (
        lines(found, events.to_cef(found), F.col("confidence"), F.col("path").cast("long"))
        .unionByName(lines(gaps, events.needs_ocr_cef(F.col("path")), F.lit("medium"), key))
        .unionByName(lines(summary, events.summary_cef(summary), F.lit(""), F.col("findings")))
    )
    return events.parse_cef(every).select(
        "event", "tool", "version", "severity", "host", "timestamp", "masked", "path", "file_name", "category", "category_id",
        "confidence", "line", "match", "context", "ocr", "folder", "subject", "date", "from", "attachment",
        "duration", "findings", "files_scanned", "files_need_ocr", "files_errored",
    )


@query(
    "syslog_frame",
    f"""select event_id, '<' || case event_type when 'error' then '132' when 'click' then '133' else '134' end || '>' ||
    strftime(ts, '%b ') || lpad(cast(day(ts) as varchar), 2, ' ') || strftime(ts, ' %H:%M:%S') || ' host-' || user_id || ' pii-scan: ' || props as frame
    from events""",
)
def syslog_frame(spark, sf):
    level = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    host = F.concat(F.lit("host-"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", events.syslog_frame(F.col("props"), level, F.col("ts"), host).alias("frame")
    )


@query(
    "union_events",
    "with recursive " + _COVERAGE + ", " + DOC.removeprefix("with recursive ")
    + """ select 'finding' as event, 'h1' as host, '2024-02-05T00:00:00Z' as "timestamp", id as path, category, confidence, line, cast(null as bigint) as findings from found
    union all select 'needs_ocr', 'h1', '2024-02-05T00:00:00Z', path, null, null, null, null from cov where status = 'needs_ocr'
    union all select 'scan_summary', 'h1', '2024-02-05T00:00:00Z', null, null, null, null, (select count(*) from found)""",
)
def union_events(spark, sf):
    found, coverage = doc_findings(spark, sf), _coverage(spark, sf)
    now, host = F.expr(NOW), F.lit("h1")
    summary = rollup.run_summary(found, coverage, roots=["/share"], duration="1s")
    everything = events.union_events(
        events.to_events(found, now, host),
        events.needs_ocr_events(coverage.where(F.col("status") == "needs_ocr").select("path"), now, host),
        events.summary_event(summary, now, host),
    )
    return everything.select("event", "host", "timestamp", "path", "category", "confidence", "line", "findings")


@query(
    "event_lines",
    DOC + f""" select id as path, s as start_at, category, 'pii-scan' as tool, 'finding' as event, {O.slug('category')} as category_id,
    line, "match", context from found""",
)
def event_lines(spark, sf):
    from veilscan.sources.eventlog import from_lines

    found = doc_findings(spark, sf)
    written = events.to_events(found, F.expr(NOW), F.lit("h1"), keep=["start"])
    lines = written.select(events.event_json(written.drop("start")).alias("value"), "start")
    return from_lines(lines, keep=["start"]).select(
        "path", F.col("start").alias("start_at"), "category", "tool", "event", "category_id", "line", "match", "context"
    )


def _alert_sql() -> str:
    ssn = "category_id in ('ssn', 'itin', 'credit-card')"
    hipaa = "category_id in ('medicare-id-hipaa', 'medical-record-number-hipaa', 'diagnosis-code-hipaa')"
    cmmc = "category_id in ('document-marking-cmmc', 'scope-indicator-cmmc')"
    high, medium = "confidence = 'high'", "confidence = 'medium'"
    ocr, mail, att = "coalesce(ocr, false)", "coalesce(subject, '') <> ''", "coalesce(attachment, '') <> ''"
    escalated = f"({ssn} or {hipaa} or {cmmc})"
    rules = (
        (100951, 10, f"{high} and not ({ocr}) and not ({mail})"),
        (100952, 7, f"{medium} and not ({mail})"),
        (100953, 12, f"{ssn} and not ({ocr}) and not ({mail})"),
        (100954, 12, f"{hipaa} and not ({ocr}) and not ({mail})"),
        (100962, 10, f"{cmmc} and not ({ocr}) and not ({mail})"),
        (100959, 8, f"{high} and {ocr}"),
        (100960, 10, f"{ssn} and {ocr}"),
        (100961, 10, f"{hipaa} and {ocr}"),
        (100963, 8, f"{cmmc} and {ocr}"),
        (100970, 10, f"({high} or {medium}) and {mail} and not ({att})"),
        (100971, 12, f"{escalated} and {mail} and not ({att})"),
        (100972, 12, f"{mail} and {att}"),
    )
    listed = ", ".join(f"case when {cond} then {level * 1000000 + rule} end" for rule, level, cond in rules)
    return f"list_max(list_filter([{listed}], lambda r: r is not null))"


_ALERTS = CUST + _MAIL + f""", al as (select *, {_alert_sql()} as best from (select *, {O.slug('category')} as category_id from ev))"""


def _alerts(spark, sf):
    found = _mail_columns(customer_findings(spark, sf)).withColumn("event", F.lit("finding"))
    return alerts.assign_alerts(found)


@query(
    "assign_alerts",
    _ALERTS + " select id as doc_id, s as start_at, category, cast(best % 1000000 as int) as rule_id, cast(best // 1000000 as int) as level from al where best is not null",
)
def assign_alerts(spark, sf):
    return _alerts(spark, sf).select("doc_id", F.col("start").alias("start_at"), "category", "rule_id", "level")


_GROUPS = """when 100951 then ['gdpr_II_5.1.f', 'hipaa_164.312.b', 'pci_dss_3.4'] when 100952 then ['gdpr_II_5.1.f']
    when 100953 then ['pci_dss_3.4', 'gdpr_II_5.1.f'] when 100954 then ['hipaa_164.312.b']
    when 100959 then ['gdpr_II_5.1.f', 'hipaa_164.312.b', 'pci_dss_3.4'] when 100960 then ['pci_dss_3.4', 'gdpr_II_5.1.f']
    when 100961 then ['hipaa_164.312.b'] when 100962 then ['cmmc', 'nist_800_171'] when 100963 then ['cmmc', 'nist_800_171']
    when 100970 then ['pci_dss_3.4', 'gdpr_II_5.1.f'] when 100971 then ['pci_dss_3.4', 'gdpr_II_5.1.f', 'hipaa_164.312.b']
    when 100972 then ['pci_dss_3.4', 'gdpr_II_5.1.f', 'hipaa_164.312.b']"""


@query(
    "alert_rollup",
    _ALERTS + f""" select level, compliance_group, count(*) as alerts from (select cast(best // 1000000 as int) as level,
    unnest(case best % 1000000 {_GROUPS} end) as compliance_group from al where best is not null) group by all""",
)
def alert_rollup(spark, sf):
    return rollup_alerts(_alerts(spark, sf))


def rollup_alerts(assigned: DataFrame) -> DataFrame:
    return alerts.alert_rollup(assigned)


# --- sources ---------------------------------------------------------------------


@query(
    "credential_secrets",
    f"""select 'c' || c_custkey || '.csv' as path, 2 as line, 'p,w' || c_custkey as value from customer
    where strlen('p,w' || c_custkey) >= 4 union all
    select 'c' || c_custkey || '.csv', 4, {R.digits('c_custkey', 7919, 17, 6)} from customer""",
)
def credential_secrets(spark, sf):
    exports = customers(spark, sf, R.credential_file()).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), "text"
    )
    return credentials.credential_secrets(exports)


def _messages(spark, sf):
    return mail.explode_messages(
        customers(spark, sf, R.mime_message()).select(
            F.concat(F.lit("/m/Outlook 15 Profiles/P1/d/"), F.col("c_custkey").cast("string"), F.lit(".olk15MsgSource")).alias("path"),
            F.col("text").cast("binary").alias("content"),
        )
    )


_SSN = R.dashed(R.digits("c_custkey", 7919, 104729, 9), 3, 2, 4)


@query(
    "explode_messages",
    f"""select '/m/Outlook 15 Profiles/P1/d/' || c_custkey || '.olk15MsgSource' as path, 'Outlook for Mac — P1' as folder,
    'Form ' || c_custkey as subject, '"HR Desk" <hr' || c_custkey || '@example.com>' as "from", '2025-10-08 09:15' as date,
    1 as "index", 'list.csv' as attachment,
    strlen('name,phone') + 2 + strlen('Ann,412-823-0000') as size, contains({_SSN}, '-') as has_ssn from customer""",
)
def explode_messages(spark, sf):
    a = F.explode_outer("attachments").alias("a")
    out = _messages(spark, sf).select("path", "folder", "subject", "from", "date", "index", "text", a)
    return out.select(
        "path", "folder", "subject", "from", "date", "index", F.col("a.name").alias("attachment"),
        F.col("a.size").cast("int").alias("size"), F.col("text").contains("Her SSN is ").alias("has_ssn"),
    )


@query(
    "scan_mail",
    f"""select '/m/Outlook 15 Profiles/P1/d/' || c_custkey || '.olk15MsgSource' as path, category, file_name, line, subject, attachment, "match"
    from (select c_custkey, 'Form ' || c_custkey as subject,
      unnest([{{'category': 'Email Address', 'file_name': c_custkey || '.olk15MsgSource', 'line': 1, 'attachment': null, 'match': 'hr' || c_custkey || '@example.com'}},
              {{'category': 'Email Address', 'file_name': c_custkey || '.olk15MsgSource', 'line': 1, 'attachment': null, 'match': 'team@example.com'}},
              {{'category': 'SSN', 'file_name': c_custkey || '.olk15MsgSource', 'line': 1, 'attachment': null, 'match': case when {O.valid_ssn(_SSN)} then {_SSN} end}},
              {{'category': 'Phone Number', 'file_name': 'list.csv', 'line': 2, 'attachment': 'list.csv', 'match': '412-823-' || {R.digits('c_custkey', 7, 11, 4)}}}], recursive := true)
      from customer) where "match" is not null""",
)
def scan_mail(spark, sf):
    found = scan_messages(_messages(spark, sf)).findings
    return found.select("path", "category", "file_name", "line", "subject", "attachment", "match")


@query(
    "utf16_text",
    """select doc_id, case when pairs < 8 then null when latin * 10 >= pairs * 8 and zero_low * 20 <= pairs then 'LE' end as utf16
    from (select doc_id, len(t) as pairs, len(regexp_replace(t, '[^\\x{00}-\\x{FF}]', '', 'g')) as latin,
    len(regexp_replace(t, '[^\\x{100}\\x{200}\\x{300}\\x{400}]', '', 'g')) as zero_low from (select doc_id, substr(text, 1, 4096) as t from documents))""",
)
def utf16_text(spark, sf):
    encoded = F.encode(F.col("text"), "UTF-16LE")
    return table(spark, sf, "documents").select("doc_id", files.utf16_order(encoded).alias("utf16"))


@query("findings_stream", DOC + O.masked() + _MASKED)
def findings_stream(spark, sf):
    """The documents table read as a stream, its findings written to a table."""
    source = table(spark, sf, "documents").schema
    # a glob serves a table in one file as well as one in a folder
    stream = spark.readStream.schema(source).parquet(f"{sf}/documents.parquet*")
    found = _masked_columns(scan_stream(stream, "doc_id", "text"))
    target = f"{ensure_checkpoint_dir(spark)}/findings-stream-{uuid.uuid4().hex}"
    run = (
        found.writeStream.format("parquet")
        .option("path", f"{target}/findings")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{target}/findings")


def _streamed(spark, stream: DataFrame) -> DataFrame:
    """What a stream appends until its input is read."""
    target = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def _log_stream(spark, sf) -> DataFrame:
    source = table(spark, sf, "events").schema
    return spark.readStream.schema(source).parquet(f"{sf}/events.parquet*").select(
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
        F.when(F.col("event_type") == "error", "scan_summary").otherwise("finding").alias("event"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("category"),
    )


@query(
    "finding_rates",
    """select time_bucket(interval 6 hour, ts) as window_start, time_bucket(interval 6 hour, ts) + interval 6 hour as window_end,
    event_type as category, count(*) as findings from events where event_type <> 'error'
    and time_bucket(interval 6 hour, ts) + interval 6 hour <= (select date_trunc('milliseconds', max(ts)) - interval 30 minute from events)
    group by all""",
)
def finding_rates(spark, sf):
    """The events table as a stream of findings: the windows that have left."""
    return _streamed(spark, watch.finding_rates(_log_stream(spark, sf), "6 hours", "30 minutes"))


@query(
    "silence_alerts",
    """select 'host-' || user_id as host, max(ts) as last_scan, max(ts) + interval 1 day as silent_since from events
    where event_type = 'error' group by user_id
    having epoch_ms(max(ts)) + 86400000 + 1 <= (select epoch_ms(max(ts)) - 3600000 from events)""",
)
def silence_alerts(spark, sf):
    """The events table as a stream: hosts whose last summary is over a day old at its end."""
    return _streamed(spark, watch.silence_alerts(_log_stream(spark, sf), days=1))


# --- smaller operators of their own -------------------------------------------------


@query(
    "looks_like_text",
    """select c_custkey, (c_custkey % 7) * 100 // (length(c_name) + c_custkey % 7) < 5 and c_custkey % 5 <> 0 as is_text
    from customer""",
)
def looks_like_text(spark, sf):
    control = F.expr("concat(c_name, repeat(chr(1), cast(c_custkey % 7 as int)), if(c_custkey % 5 = 0, chr(0), ''))")
    return table(spark, sf, "customer").select("c_custkey", files.looks_like_text(control).alias("is_text"))


@query("utf16_big_endian", "select c_custkey, 'BE' as plain, 'LE' as marked from customer")
def utf16_big_endian(spark, sf):
    text = F.concat("c_name", "c_mktsegment")
    plain, little = F.encode(text, "UTF-16BE"), F.encode(text, "UTF-16LE")
    marked = F.concat(F.unhex(F.lit("FFFE")), little)
    return table(spark, sf, "customer").select(
        "c_custkey", files.utf16_order(plain).alias("plain"), files.utf16_order(marked).alias("marked")
    )


@query("limit_size", "select c_custkey from customer where c_custkey * 1000 <= 1048576")
def limit_size(spark, sf):
    sized = table(spark, sf, "customer").withColumn("length", F.col("c_custkey") * 1000)
    return files.limit_size(sized, 1).select("c_custkey")


@query("attachment_filter", f"select path from {_PATHS} where not regexp_matches(path, '[.]zip$')")
def attachment_filter(spark, sf):
    return mail.attachment_filter(paths(spark, sf), "path").select("path")


@query(
    "list_categories",
    DOC + """ select position, c.category, count(f.category) as findings from (select unnest(range(1, 16))::int as position,
    unnest(['SSN', 'ITIN', 'Credit Card', 'Email Address', 'Phone Number', 'Date of Birth', 'Driver''s License',
    'Passport Number', 'Bank Routing Number', 'Bank Account Number', 'Medicare ID (HIPAA)', 'Medical Record Number (HIPAA)',
    'Diagnosis Code (HIPAA)', 'Document Marking (CMMC)', 'Scope Indicator (CMMC)']) as category) c
    left join found f on f.category = c.category group by all""",
)
def list_categories(spark, sf):
    found = doc_findings(spark, sf).groupBy("category").agg(F.count("*").alias("findings"))
    listed = detectors.list_categories(spark).join(found, "category", "left")
    return listed.select("position", "category", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def _exports(spark, sf):
    return customers(spark, sf, R.credential_file()).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), "text"
    )


@query(
    "attach_secrets",
    O.detection("customer", "'c' || c_custkey || '.csv'", R.credential_file())
    + """ select id as path, s as start_at, line, case when line = 4 then 1 when line = 2 and len(id) >= 6 then 1 else -1 end::int as hidden
    from found""",
)
def attach_secrets(spark, sf):
    exports = _exports(spark, sf)
    found = scan_table(exports, "path", "text").withColumnRenamed("start", "start_at")
    with_them = masking.attach_secrets(found, credentials.credential_secrets(exports))
    return with_them.select("path", "start_at", "line", F.coalesce(F.size("redact"), F.lit(-1)).alias("hidden"))


@query(
    "stream_secrets",
    O.detection("customer", "'c' || c_custkey || '.csv'", R.credential_file())
    + f""" select id as path, s as start_at, category, case when {O.plain()} then "match" else {O.mask('"match"')} end as "match",
    false as leaks from found""",
)
def stream_secrets(spark, sf):
    """Masked findings of password exports that arrive as a stream."""
    source = table(spark, sf, "customer").schema
    arriving = spread(spark.readStream.schema(source).parquet(f"{sf}/customer.parquet*")).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"),
        F.expr(R.credential_file()).alias("text"),
    )
    shown_ = _streamed(spark, scan_stream(arriving, "path", "text").withColumnRenamed("start", "start_at"))
    password = F.concat(F.lit("p,w"), F.regexp_extract("path", "[0-9]+", 0), F.lit('"'))
    return shown_.select("path", "start_at", "category", "match", F.col("context").contains(password).alias("leaks"))


@query(
    "ocr_text_status",
    f"""select path, case when c_custkey % 17 = 0 then 'oversize' when {_KIND_SQL} in ('docx', 'xlsx') then 'error'
    when {_KIND_SQL} = 'mail_store' then 'mail_store' when {_KIND_SQL} = 'unreadable_doc' then 'unreadable_doc'
    when {_KIND_SQL} = 'binary' then 'skipped' when {_KIND_SQL} in ('text', 'sniff') then 'scanned'
    when c_custkey % 2 = 0 and c_custkey % 4 = 0 then 'scanned' else 'needs_ocr' end as status from {_PATHS}""",
)
def ocr_text_status(spark, sf):
    listed = paths(spark, sf).select(
        "path", "c_custkey", F.lit(9).cast("long").alias("length"), F.encode(F.lit("some text"), "UTF-8").alias("content"),
        files.classify_file(F.col("path")).alias("kind"), F.lit(False).alias("excluded"),
        (F.col("c_custkey") % 17 == 0).alias("oversize"),
    )
    given = listed.where("c_custkey % 2 = 0").select(
        "path", F.when(F.col("c_custkey") % 4 == 0, F.repeat(F.lit("words "), 9)).otherwise(F.lit(" ")).alias("text"), F.lit(False).alias("ocr")
    )
    return files.extract_text(listed, ocr_text=given, ocr=True).select("path", "status")


@query("gap_alerts", f"select path, 'needs_ocr' as event, 100955 as rule_id, 5 as level from {_PATHS}")
def gap_alerts(spark, sf):
    gaps = events.needs_ocr_events(paths(spark, sf), F.expr(NOW), F.lit("h1"))
    for name in ("confidence", "category_id", "subject", "attachment"):
        gaps = gaps.withColumn(name, F.lit(None).cast("string"))
    return alerts.assign_alerts(gaps.withColumn("ocr", F.lit(None).cast("boolean"))).select("path", "event", "rule_id", "level")


@query(
    "sql_functions",
    f"select c_custkey, {O.mask('c_name')} as masked, {O.slug('c_mktsegment')} as slug, {O.valid_aba(R.digits('c_custkey', 7919, 17, 9))} as aba from customer",
)
def sql_functions(spark, sf):
    sql.register_functions(spark)
    number = R.digits("c_custkey", 7919, 17, 9)
    return table(spark, sf, "customer").selectExpr(
        "c_custkey", "pii_mask(c_name) masked", "pii_category_slug(c_mktsegment) slug", f"pii_aba({number}) aba"
    )


@query("pii_scan", DOC + " " + SHOWN_SQL)
def pii_scan(spark, sf):
    sql.register_scan_functions(spark)
    return spark.sql(
        """SELECT CAST(d.doc_id AS STRING) doc_id, f.category, f.confidence, f.line, f.match, f.start start_at, f.end end_at
        FROM {docs} d, LATERAL pii_scan(d.text) f""",
        docs=documents(spark, sf),
    )


@query(
    "pii_findings",
    CUST + """ , ids as (select cast(c_custkey as varchar) as id from customer)
    select id as doc_id, count(category) as findings, coalesce(max(context) filter (s = (select min(s) from found x where x.id = ids.id)), '') as first_context
    from ids left join found using (id) group by id""",
)
def pii_findings(spark, sf):
    sql.register_scan_functions(spark, prefix="customer_pii")
    return spark.sql(
        """SELECT CAST(c_custkey AS STRING) doc_id, CAST(coalesce(size(f), 0) AS BIGINT) findings,
            coalesce(array_max(filter(f, x -> x.start = f[0].start).context), '') first_context
        FROM (SELECT c_custkey, customer_pii_findings(text) f FROM {records})""",
        records=customers(spark, sf),
    )


@query(
    "register_detector",
    r"""select doc_id, count(*)::bigint as hits from (select doc_id,
    unnest(regexp_extract_all(text, '\b[0-9]{3}[.][0-9]{2}\b')) from documents) group by doc_id""",
)
def register_detector(spark, sf):
    own = detectors.register_detector(detectors.Detector("Price", r"\b[0-9]{3}[.][0-9]{2}\b"), detectors.Registry(()))
    found = scan_table(documents(spark, sf), "doc_id", "text", registry=own)
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("hits"))


@query(
    "scan_history",
    CUST + """ select 'scan-2024-02-05_000000' as name, count(*) as findings from found union all
    select 'scan-2024-02-06_000000', count(*) from found where confidence = 'high'""",
)
def scan_history(spark, sf):
    """The archive of two runs, read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    for day, level in (("2024-02-05", "low"), ("2024-02-06", "high")):
        # counted for the header and written: scanned once
        found = materialize(customer_findings(spark, sf, min_confidence=level))
        coverage = table(spark, sf, "customer").selectExpr("cast(c_custkey as string) path", "'scanned' status")
        summary = rollup.run_summary(found, coverage, roots=["customer"], duration="1s")
        header = reports.report_header(summary, F.lit(day).cast("timestamp"))
        reports.archive_run(header, found, folder)
    return reports.scan_history(reports.read_archive(spark, folder)).select("name", "findings")
