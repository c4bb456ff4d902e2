import os
import sys
from datetime import date, datetime
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from folio.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


# A small collection of one tenant, for the engine.
TEXTS = {
    "d1": "The lease of the harbour office ends on 3 May 2027. It may be renewed once. The monthly rent is 900 EUR.",
    "d2": "Invoice INV-77-0048 of Lumen Harrow Ltd. The amount of 1,200 EUR is due within thirty days.",
    "d3": "There are 14 forklifts in the northern warehouse. Suppliers were invoiced in March.",
    "d4": "Each supplier keeps all documents in confidence. " + "More about other matters. " * 40 + "Payment follows within  thirty\ndays of the invoice.",
}


@pytest.fixture(scope="session")
def engine(spark, tmp_path_factory):
    from folio.operators.engine import Engine, TenantCatalog

    d = str(tmp_path_factory.mktemp("engine"))
    at = datetime(2026, 1, 1)
    docs = [(t, k, f"{k}_{n}.txt", f"Title {k}", n, "indexed", "en", "text", ".txt", False) for t, k, n in (("t", "d1", "lease_agreement"), ("t", "d2", "invoice"), ("t", "d3", "memo"), ("t", "d4", "nda"), ("other", "x1", "memo"))]
    spark.createDataFrame(docs, "tenant_id string, document_id string, filename string, title string, doc_type string, status string, language string, kind string, file_ext string, has_signature boolean").write.parquet(f"{d}/documents.parquet")
    units = [("t", k, f"{k}:0", 0, 1, "passage", text, 0, at) for k, text in TEXTS.items()] + [("t", "d3", "d3:s", 9, 1, "document", "quarterly ledger", None, at), ("other", "x1", "x1:0", 0, 1, "passage", "forklifts forklifts lease", 0, at)]
    spark.createDataFrame(units, "tenant_id string, document_id string, unit_id string, ordinal int, page int, unit_type string, text string, char_start int, stored_at timestamp").write.parquet(f"{d}/units.parquet")
    spark.createDataFrame([("t", k, 1, text) for k, text in TEXTS.items()], "tenant_id string, document_id string, page int, text string").write.parquet(f"{d}/pages.parquet")
    at = TEXTS["d2"].index("Lumen")
    spark.createDataFrame([("t", "d2", "organization", "Lumen Harrow Ltd", "lumen harrow ltd", 1, at, at + 16)], "tenant_id string, document_id string, type string, value string, value_norm string, page int, char_start int, char_end int").write.parquet(f"{d}/entities.parquet")
    spark.createDataFrame([("t", "d4", "confidentiality", 1, 0, 47)], "tenant_id string, document_id string, clause_type string, page int, char_start int, char_end int").write.parquet(f"{d}/clauses.parquet")
    facts = [("d1", "expiry_date", None, None, date(2027, 5, 3), None), ("d2", "total_amount", None, 1200.0, None, "EUR"), ("d2", "issue_date", None, None, date(2024, 2, 1), None), ("d3", "issue_date", None, None, date(2023, 2, 1), None), ("d3", "total_amount", None, 50.0, None, "EUR")]
    fields = spark.createDataFrame([(*f, 1.0, k) for k, f in enumerate(facts)], "document_id string, name string, value_text string, value_num double, value_date date, unit string, confidence double, field_id int")
    return Engine(TenantCatalog(spark, d, "t"), fields)
