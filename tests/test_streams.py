"""Streams that keep state: the batcher, the resumable pages; and the expansion of sitemaps."""

import json
import time

import pytest

from tenderloom.sources import files
from tenderloom.sources.pages import PageError, pages, publish_pass
from tenderloom.streaming.batcher import batches


def land(folder, number, ids, count=100):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{number:05d}.json").write_text(json.dumps({"count": count, "items": [{"id": i, "name": f"item {i}"} for i in ids]}))


def take(spark, folder, out, checkpoint):
    q = pages(spark, str(folder), stream=True).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(str(out))


def test_a_stopped_stream_goes_on_with_the_first_observed_at(spark, tmp_path):
    folder = tmp_path / "pass"
    land(folder, 0, [1, 2]), land(folder, 1, [3]), land(folder, 3, [9])  # page 2 has not landed
    first = take(spark, folder, tmp_path / "out", tmp_path / "check")
    assert sorted(r["id"] for r in first.collect()) == ["1", "2", "3"]
    time.sleep(1.1)
    land(folder, 2, [4, 5])
    both = take(spark, folder, tmp_path / "out", tmp_path / "check").collect()
    assert sorted((r["page"], r["position"], r["id"]) for r in both) == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3"), (2, 0, "4"), (2, 1, "5"), (3, 0, "9")]
    assert len({r["observed_at"] for r in both}) == 1
    land(folder, 3, [8]), land(folder, 4, [10])  # the last page read is another now
    with pytest.raises(Exception, match="not the one that was read"):
        take(spark, folder, tmp_path / "out", tmp_path / "check")


def test_two_passes_must_agree(spark, tmp_path):
    for name, last in (("a", 3), ("b", 3), ("c", 4)):
        land(tmp_path / name, 0, [1, 2]), land(tmp_path / name, 1, [last])
    a, b, c = (pages(spark, str(tmp_path / n)) for n in "abc")
    out = tmp_path / "published"
    assert not publish_pass(a, c, 3, str(out)) and not publish_pass(a, b, 4, str(out)) and not out.exists()
    assert publish_pass(a, b, 3, str(out)) and spark.read.parquet(str(out)).count() == 3
    (tmp_path / "d").mkdir()
    assert pages(spark, str(tmp_path / "d")).count() == 0
    (tmp_path / "d" / "page-00000.json").write_text('{"count": true, "items": []}')
    with pytest.raises(Exception, match=PageError.__name__):
        pages(spark, str(tmp_path / "d")).count()


def test_batches_go_when_full_or_due_and_survive_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def put(ids):
        spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, document string").coalesce(1).write.mode("append").parquet(source)

    def start(wait_ms):
        stream = spark.readStream.schema("id long, document string").parquet(source)
        query = batches(stream, 4, wait_ms, lanes=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        return query.trigger(processingTime="300 milliseconds").start()

    def seen():
        return sorted((sorted(map(int, r["ids"])), r["reason"]) for r in spark.read.schema("lane int, ids array<string>, documents array<string>, reason string").parquet(out).collect())

    def until(n, query):
        for _ in range(120):
            if query.exception():
                raise query.exception()
            if (tmp_path / "out").exists() and len(seen()) >= n:
                return
            time.sleep(0.5)

    put(range(6))
    query = start(600_000)
    until(1, query)
    query.stop()
    (full,) = seen()
    assert full[1] == "full" and len(full[0]) == 4
    query = start(600_000)  # two wait in the state; two more make a batch
    put([10, 11])
    until(2, query)
    query.stop()
    assert sorted(i for ids, _ in seen() for i in ids) == [0, 1, 2, 3, 4, 5, 10, 11] and {r for _, r in seen()} == {"full"}
    query = start(1_500)
    put([20])
    until(3, query)
    query.stop()
    assert ([20], "due") in seen() and len(seen()) == 3


def test_sitemaps(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in u) + "</sitemapindex>"
    urls = lambda *u: "<urlset xmlns='x'>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    held = [("r", index("a", "b", "gone", "bad", "r")), ("a", urls("p1", "p2")), ("b", index("c", "a")), ("c", index("d")), ("d", urls("deep")), ("bad", "<html>"), ("gone", None), ("s", urls("p1"))]
    df = spark.createDataFrame(held, "url string, content string")
    found = lambda *roots: sorted(tuple(r) for r in files.expand_sitemaps(df, spark.createDataFrame([(r,) for r in roots], "root string")).collect())
    assert found("r", "s", "c") == [("c", "deep"), ("r", "p1"), ("r", "p2"), ("s", "p1")]
    for root in ("gone", "bad", "nowhere"):
        with pytest.raises(ValueError, match=root):
            found("r", root)
