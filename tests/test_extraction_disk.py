import os
import random

from weftgraph.operators import crawl_store as cs, extraction as ex
from weftgraph.sources.store import Store

KIND = "url string, status string, body_text string"
LINKS = "src string, href string, url string, text string, region string, in_scope boolean, operator boolean"


def size_of(folder):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(folder) for f in files)


def test_rare_runs_are_not_kept(spark, tmp_path):
    rng, store = random.Random(5), Store(spark, f"file://{tmp_path}/store")
    notice = "a b c d e f g h i"  # two runs of eight words
    bodies = {f"u{k}": " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) + (f" {notice}" if k < 3 else "") for k in range(100)}
    settings, shared = ex.Settings(window_pages=3), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")

    def crawl(urls):
        change = store.change()
        cs.save_crawled(change, spark.createDataFrame([(u, "ok", bodies[u]) for u in urls], KIND), spark.createDataFrame([], LINKS))
        told = ex.extract(store, change, [("T", "end", ["i"])], settings)
        change.publish()
        return told, store.table("common_runs").count(), {r["url"] for r in store.table("page_entities").collect()}

    before = size_of(shared)
    assert crawl(bodies) == ({"pages": 100, "read": 100, "gone": 0, "dropped_words": 27}, 2, set())
    assert not store.snapshot().files("run_counts")  # a row for each run stood there
    assert size_of(shared) - before < sum(map(len, bodies.values()))
    bodies["u0"] = "x"  # the notice is rare now: the two other pages that hold it are read again
    told, common, tagged = crawl(["u0"])
    assert (told["read"], common, tagged) == (3, 0, {"u1", "u2"})
    bodies["u7"] += f" {notice}"
    told, common, tagged = crawl(["u7"])
    assert (told["read"], common, tagged) == (3, 2, set())
