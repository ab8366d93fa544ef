import random
import re
import time

from hypothesis import given, settings, strategies as st

from weftgraph.functions.terms import Terms, folded, needle, term_pattern
from weftgraph.operators import entities

LISTS = [["and", "und"], ["tion*", "ab"], ["new york", "york city", "york"], ["c++", "a_b"], ["re:[a-z]{2}\\d+"], ["re:ware(house|s)", "depot*"], ["York New*"], ["é*", "straße"]]


def slow(text, lists):
    found = {k: len(re.findall(term_pattern(terms), text, re.IGNORECASE)) for k, terms in enumerate(lists)}
    return {k: n for k, n in found.items() if n}


WORDS = ["and", "AND", "und", "nation", "tion", "tions", "ab", "abc", "new", "York", "city", " ", "\n\t", "c++", "c++x", "a_b", "_", "xy12", "warehouse", "Wares", "Depots", "é", "École", "STRASSE", "Straße", ".", "-"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=30), st.sampled_from(["", " ", "\n"]))
def test_counts_as_an_alternation_does(parts, between):
    text = between.join(parts)
    assert Terms(LISTS).counts(text) == slow(text, LISTS)


def test_case_of_other_letters():
    assert folded("ÀÉK ſ İ") == "àék s i"
    assert Terms([["kelvin*"]]).counts("KELVINS kelvin") == {0: 2}


def test_needles():
    assert needle("ware(house|s)") == "ware" and needle("[a-z]+x") is None and needle("a|bcde") is None and needle("(?i)ABCdef\\d") == "abcdef"


def test_time_does_not_grow_with_the_number_of_terms():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    text = " ".join(word() for _ in range(20_000))
    few, many = Terms([[word()] for _ in range(100)]), Terms([[word(), f"{word()} {word()}"] for _ in range(10_000)])

    def seconds(terms):
        least = 9.0
        for _ in range(3):
            began = time.process_time()
            terms.counts(text)
            least = min(least, time.process_time() - began)
        return least

    assert seconds(many) < 5 * seconds(few) + 0.05


def test_many_entities_over_pages(spark):
    rng = random.Random(2)
    taxonomy = [("T", f"e{k}", [f"word{k}", f"other {k}*"]) for k in range(10_000)]
    pages = [(f"p{k}", f"word{rng.randrange(10_000)}", [f"Other  {rng.randrange(10_000)}"], " ".join(f"WORD{rng.randrange(10_000)}" for _ in range(20))) for k in range(30)]
    pages += [("none", None, None, None), ("empty", "", [], "")]
    found = entities.tag_entities(spark.createDataFrame(pages, "url string, title string, headings array<string>, body string"), taxonomy, least_score=1.0)
    rows = {(r["url"], r["entity"]): (r["score"], r["evidence"]) for r in found.collect()}
    for url, title, headings, body in pages[:5]:
        assert rows[url, f"e{title[4:]}"][1] == "title" and (url, f"e{headings[0].split()[1]}") in rows
        assert all((url, f"e{w[4:]}") in rows for w in body.split())
    assert not any(url in ("none", "empty") for url, _ in rows)


def test_first_field_then_first_term(spark):
    fields = spark.createDataFrame([("a", "beta", "alpha", None, "gamma", ""), ("b", "", "", "", "", "x alphas")], "url string, " + ", ".join(f"{f} string" for f in entities.FIELDS))
    found = entities.tag_topics(fields, [("One", ["alpha", "beta"]), ("Two", ["gamma", "re:alph\\w+"])])
    assert sorted(map(tuple, found.collect())) == [("a", "One", "title", "beta"), ("a", "Two", "h1", "re:alph\\w+"), ("b", "Two", "url_path", "re:alph\\w+")]
