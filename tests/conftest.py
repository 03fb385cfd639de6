import pytest

from veilscan.session import builder, ship


@pytest.fixture(scope="session")
def spark():
    session = (
        builder("tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture()
def scan(spark):
    """Findings of texts given as {id: text}, as {id: [Row, ...]} in order."""
    from veilscan.operators.scan import scan_table

    def run(texts, **options):
        rows = [(str(k), v) for k, v in texts.items()]
        kind = "binary" if rows and isinstance(rows[0][1], bytes) else "string"
        found = scan_table(spark.createDataFrame(rows, f"id string, text {kind}"), "id", "text", **options)
        out = {k: [] for k, _ in rows}
        for row in found.collect():
            out[row["doc_id"]].append(row)
        for rows_of in out.values():
            rows_of.sort(key=lambda r: (r["start"], -r["end"]))
        return out

    return run
