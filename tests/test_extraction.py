import random

import pytest

from weftgraph.operators import crawl_store as cs, extraction as ex
from weftgraph.sources.store import Store

TAXONOMY = [("T", "alpha", ["alpha", "alphas"]), ("T", "beta gamma", ["beta gamma"]), ("N", "number", ["re:n\\d+"])]
SETTINGS = ex.Settings(window=4, window_pages=3, heading_pages=3, least_score=1.0)
NOTICE = "this notice stands on many pages alpha of the site"


def page(rng, k, notice=True):
    words = [rng.choice(("alpha", "beta", "gamma", "n7", "x", "y", f"w{k}", f"v{rng.randrange(99)}")) for _ in range(25)]
    if notice:
        words[10:10] = NOTICE.split()
    return f"https://s.test/{k}", "ok", f"title {rng.choice(('alpha', 'n1', ''))}", [(1, "Common head" if k % 2 else f"Head {k}"), (2, f"beta gamma {k}")], " ".join(words)


KIND = "url string, status string, title string, headings array<struct<level:int,text:string>>, body_text string"


def save(spark, store, rows):
    change = store.change()
    none = spark.createDataFrame([], "src string, href string, url string, text string, region string, in_scope boolean, operator boolean")
    cs.save_crawled(change, spark.createDataFrame(rows, KIND), none)
    return change


def slow(rows):
    """Tags of all pages, counted page by page."""
    counts, heads = {}, {}
    for _, _, _, headings, body in rows:
        texts = [h for _, h in headings]
        for run in set(ex.runs_of(ex.words_of(body, texts), 4)):
            counts[run] = counts.get(run, 0) + 1
        for h in {" ".join(h.lower().split()) for h in texts}:
            heads[h] = heads.get(h, 0) + 1
    from weftgraph.functions.terms import Terms

    terms, out = Terms([t for *_, t in TAXONOMY]), set()
    for url, _, title, headings, body in rows:
        words, gone = ex.words_of(body, [h for _, h in headings]), set()
        for k, run in enumerate(ex.runs_of(words, 4)):
            if counts[run] >= 3:
                gone |= set(range(k, k + 4))
        left = []
        for k, w in enumerate(words):
            if k not in gone:
                left += (["|"] if left and k - 1 in gone else []) + [w]
        kept = [h for _, h in headings if heads[" ".join(h.lower().split())] < 3]
        hits = [terms.counts(title), {}, terms.counts(" ".join(left))]
        for h in kept:
            for e, n in terms.counts(h).items():
                hits[1][e] = hits[1].get(e, 0) + n
        for e, (kind, name, _) in enumerate(TAXONOMY):
            n = [h.get(e, 0) for h in hits]
            score = 3.0 * n[0] + 2.0 * n[1] + min(n[2], 5)
            if score >= 1:
                out.add((url, kind, name, score, next(x for x, y in zip(("title", "heading", "body"), n) if y)))
    return out


def tags(store):
    return set(map(tuple, store.table("page_entities").collect()))


def test_later_extractions_equal_new_ones(spark, tmp_path):
    rng, store = random.Random(1), Store(spark, f"file://{tmp_path}/store")
    rows = {k: page(rng, k, notice=k < 2) for k in range(11)} | {11: ("https://s.test/short", "ok", "alpha", [], "two words")}
    change = save(spark, store, list(rows.values()))
    assert ex.extract(store, change, TAXONOMY, SETTINGS)["read"] == 12
    change.publish()
    assert tags(store) == slow(list(rows.values()))
    files = set(store.snapshot().files("run_counts"))
    # one page changes, without the notice: only it is read
    rows[5] = page(rng, 5, notice=False)
    change = save(spark, store, [rows[5]])
    assert ex.extract(store, change, TAXONOMY, SETTINGS)["read"] == 1
    change.publish()
    assert tags(store) == slow(list(rows.values())) and files <= set(store.snapshot().files("run_counts"))
    # a third page with the notice makes it common: those with it are read again
    rows[7] = page(rng, 7)
    change = save(spark, store, [rows[7]])
    assert ex.extract(store, change, TAXONOMY, SETTINGS)["read"] == 3
    change.publish()
    assert tags(store) == slow(list(rows.values()))
    # nothing changed; then a page is gone and the notice is rare again
    change = store.change()
    assert ex.extract(store, change, TAXONOMY, SETTINGS) == {"pages": 12, "read": 0, "gone": 0}
    change.delete("pages", spark.createDataFrame([(rows[0][0],)], "url string"), ["url"])
    assert ex.extract(store, change, TAXONOMY, SETTINGS)["gone"] == 1
    change.publish()
    del rows[0]
    assert tags(store) == slow(list(rows.values()))
    # a heading becomes common, others are rare
    rows[3] = (*rows[3][:3], [(1, "Head 4")], rows[3][4])
    rows[6] = (*rows[6][:3], [(1, "HEAD  4")], rows[6][4])
    change = save(spark, store, [rows[3], rows[6]])
    assert ex.extract(store, change, TAXONOMY, SETTINGS)["read"] == 3
    change.publish()
    assert tags(store) == slow(list(rows.values()))


@pytest.mark.parametrize("what", ["settings", "taxonomy", "vacuum"])
def test_other_settings_mean_a_new_extraction(spark, tmp_path, what):
    rng, store = random.Random(2), Store(spark, f"file://{tmp_path}/store")
    change = save(spark, store, [page(rng, k) for k in range(4)])
    ex.extract(store, change, TAXONOMY, SETTINGS)
    change.publish()
    change = save(spark, store, [page(rng, 9)])
    change.publish()
    if what == "vacuum":
        store.vacuum()
    change = store.change()
    found = ex.extract(store, change, TAXONOMY[:2] if what == "taxonomy" else TAXONOMY, ex.Settings(window=5) if what == "settings" else SETTINGS)
    assert found["read"] == 5
