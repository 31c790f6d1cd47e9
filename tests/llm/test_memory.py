"""What Python workers keep when a task is done."""

from pathlib import Path

from harborlight.llm import common


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_freed_memory_goes_back_after_a_task():
    seen = {}

    def work(batches):
        held = [bytes(70_000) for _ in range(3000)]
        # What stays is spread among what goes, so nothing goes back by itself.
        seen["kept"] = held[::300] + held[-1:]
        yield from batches
        seen["high"] = resident_mb()

    assert list(common.freed(work)(iter([1, 2]))) == [1, 2]
    assert resident_mb() < seen["high"] - 150


def test_memory_goes_back_also_after_a_failure(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))

    def work(batches):
        yield next(batches)
        raise ValueError

    try:
        list(common.freed(work)(iter([1])))
    except ValueError:
        told.append(2)
    assert told == [1, 2]


def test_near_duplicates_need_no_other_kind_of_worker(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(6)], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert "ExistingRDD" not in kept._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]
