"""Providers, settings, layouts, discovery and reports."""

import time

import pytest
from pyspark.sql import functions as F

from factloom.plans import views
from factloom.settings import settings
from factloom.sources import documents, replay, store


def asked(spark, texts, providers, **how):
    df = spark.createDataFrame([(str(i), "d", t, 0, str(i)) for i, t in enumerate(texts)], "id string, document_id string, text string, char_start int, passage_hash string").coalesce(1)
    return {r["id"]: r for r in replay.fetched(df, providers, **how).collect()}


def test_a_failed_model_is_dropped(spark):
    def broken(text):
        raise RuntimeError("down")

    got = asked(spark, ["a", "b", "c"], [("x", broken), ("y", lambda t: f'{{"facts":[]}}{t}'[:12])], concurrency=1)
    assert [(r["model"], r["calls"], r["reason"]) for _, r in sorted(got.items())] == [("y", 2, None), ("y", 1, None), ("y", 1, None)]
    got = asked(spark, ["a", "b"], [("x", broken)], concurrency=1)
    assert [(r["model"], r["calls"], r["reason"]) for _, r in sorted(got.items())] == [(None, 1, "provider: RuntimeError"), (None, 0, "provider: no model is left")]


def test_deadline(spark):
    def slow(text):
        time.sleep(3 if text == "slow" else 0)
        return "{}"

    got = asked(spark, ["fast", "slow", "later"], [("x", slow)], deadline=1.0, concurrency=1)
    assert got["0"]["response_json"] == "{}" and got["1"]["reason"].startswith("deadline") and got["2"]["reason"].startswith("deadline")


def test_answer_statistics(spark):
    cached = spark.createDataFrame([("{}",), (None,)], "response_json string")
    calls = spark.createDataFrame([("{}", 1, None), (None, 2, "provider: X"), (None, 0, "deadline: not asked")], "response_json string, calls int, reason string")
    items = spark.createDataFrame([(None,), ("schema: x",)], "reason string")
    assert replay.answer_statistics(cached, calls, items).first()[:] == (1, 3, 3, 1, 1, 1, 2, 1, 1)
    assert replay.answer_statistics(cached.limit(0), calls.limit(0), items.limit(0)).first()[:] == (0,) * 9


def test_settings(tmp_path, monkeypatch):
    file = tmp_path / ".env"
    file.write_text("# note\nexport FACTLOOM_BUDGET = 7\nFACTLOOM_DEADLINE=0\nFACTLOOM_TABLES='x'\nFACTLOOM_OFFLINE=yes\n")
    monkeypatch.setenv("FACTLOOM_MODELS", " a, b ,")
    got = settings(str(file), tables="mine")
    assert (got.tables, got.models, got.budget, got.deadline, got.offline) == ("mine", ("a", "b"), 7, 0.1, True)
    monkeypatch.setenv("FACTLOOM_BUDGET", "many")
    monkeypatch.setenv("FACTLOOM_MODELS", "")
    assert settings(str(file)).budget == 150 and settings(str(file)).models == ()


def test_layouts(spark):
    old = {"passages": spark.createDataFrame([("p",)], "id string"), "answers": spark.createDataFrame([("h",)], "passage_hash string")}
    new = store.migrated(old, 1)
    assert new["passages"].first()["role"] == "body" and new["answers"].first()["schema_version"] == 1
    assert store.migrated(old, store.VERSION)["passages"].columns == ["id"]
    for version in (0, store.VERSION + 1):
        with pytest.raises(ValueError):
            store.migrated(old, version)


def test_discovery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.Pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "b.pdf").write_bytes(b"none")
    (tmp_path / "c.txt").write_text("text")
    (tmp_path / "empty").mkdir()
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in documents.discover(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "a.Pdf")]).collect()}
    assert got == {"a.Pdf": None, "b.pdf": "no PDF header"}
    for wrong in ("c.txt", "empty"):
        with pytest.raises(ValueError):
            documents.discover(spark, [str(tmp_path / wrong)])


def test_document_list_and_report(spark, tmp_path):
    docs = spark.createDataFrame([("b", "complete", 1), ("a", "complete", 1), ("c", "failed", 0)], "id string, status string, created_at int").withColumn("extraction_mode", F.lit("rules"))
    assert [r["id"] for r in views.documents(docs, status="complete", extraction_mode="rules").collect()] == ["a", "b"]
    views.write_json({"documents": docs}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "documents")).count() == 3
