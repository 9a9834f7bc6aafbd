import pytest

from gatewright.llm import quality as Q

COMMON = sorted(set("the of and to in a is that was for it with as on be at by this had not are but from when nobody und der die das in zu den mit ist nicht el la los en que una y это не что и за на".split()))
PROSE = "When the harbour closed, nobody in the village was sure that the boats would come back to it. "
PLAIN = "Kangal inspected polished teachers, Lissal recovered suddenly. Engineers opened harbour 53 using coastal baskets. Quiet carpets near Vashfen recovered slowly; 14 clocks worked. "
NATURAL = {
    "sentences": PROSE * 5,
    "few function words": PLAIN * 4,
    "wrapped": (PROSE * 5).replace(" that was", "\nthat was").replace(" of ", "\nof ").replace(", ", ",\n"),
    "menu first": "Home\nNews\nAbout us\n" + PROSE * 5,
    "quoted": "\n".join("> " + line for line in (PROSE * 5).replace(" sure", "\nsure").split("\n")),
    "gaps": (PROSE * 5).replace(" the ", "\tthe  "),
    "a few wrong letters": ("Cuando la bodega en la calle era vacсa, nadie que vive en la ciudad mirѓ la seёal. " * 5),
    "russian": "Это не было видно, но за рекой и на площади что-то было. " * 8,
}
JUNK = {
    "short": PROSE,
    "list": "Things\n" + "\n".join(f"- lantern for the meadow {i}" for i in range(30)),
    "list with stops": "\n".join(f"* what to do with the barn {i}." for i in range(30)),
    "numbered": "\n".join(f"{i}. in the river of the north" for i in range(30)),
    "bare entries with stops": "\n".join("lever for the roof." for _ in range(30)),
    "table": "\n".join(f"{i}.5 | the barn and the mill | n/a | river" for i in range(30)),
    "gap table": "\n".join(f"copper lantern  {i}.25  yes  barn" for i in range(30)),
    "log": "\n".join(f"2026-01-{i:02} INFO vel[{i}] code={i} t=0.1." for i in range(10, 40)),
    "code": "\n".join(f"function f{i}(a) {{ return a.b[{i}]; }}" for i in range(30)),
    "keywords": ", ".join(["copper lantern", "quiet barn", "mill for the river"] * 12) + ".",
    "salad": "Quiet wheel gentle pump experiment familiar saddle covered shallow window. " * 8,
    "function words": "The of and to in was that for it. " * 10,
    "hex": "\n".join("4e 73 fa 07 01 6b bd 5c 7c be ee da 22 b6 9c 8b" for _ in range(8)) + "\n",
    "latin-1 russian": ("Это не было видно, но за рекой и на площади что-то было. " * 8).encode("cp1251").decode("latin-1"),
    "utf-8 as latin-1": ("Это не было видно, но за рекой и на площади что-то было. " * 8).encode().decode("latin-1"),
    "koi8": ("Это не было видно, но за рекой и на площади что-то было. " * 8).encode("cp1251").decode("koi8-r"),
    "symbols": "%|{{ .:[$: _: ~.= /<; +@ " * 20,
}


@pytest.fixture(scope="module")
def judged(spark):
    docs = [(i, text, "clash", 1) for i, text in enumerate([*NATURAL.values(), *JUNK.values()])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_words string, __gw_text int")
    rows = Q.judge(df, spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")).collect()
    return dict(zip([*NATURAL, *JUNK], sorted(rows, key=lambda r: r["doc_id"])))


@pytest.mark.parametrize("name", NATURAL)
def test_natural(judged, name):
    assert judged[name]["reasons"] == [] and judged[name]["running_share"] >= 0.5, judged[name]


@pytest.mark.parametrize("name", JUNK)
def test_junk(judged, name):
    assert judged[name]["reasons"], judged[name]


def test_statistics_and_reasons(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\u00a0"), (4, "- the end\n- of it...\n\nOne\u00a0two # 3."), (5, PROSE * 20_000), (4, "x")], "doc_id bigint, text string")
    rows = {(r["doc_id"], r["n_words"]): r for r in Q.judge(docs, words).collect()}
    for i in (1, 2, 3):
        r = rows[i, 0]
        assert r["reasons"][0] == "words" and r["n_lines"] == 0 and r["mean_word_length"] == r["running_share"] == 0
    r = rows[4, 10]
    assert (r["n_lines"], r["n_common"], r["bullet_share"], r["ellipsis_share"], r["line_end_share"], r["alpha_share"]) == (3, 3, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(0.6))
    assert r["symbol_ratio"] == pytest.approx(0.2) and "symbols" in r["reasons"] and "ellipses" in r["published_reasons"] and (4, 1) in rows
    long = rows[5, 20_000 * len(PROSE.split())]
    assert long["reasons"] == [] and long["published_reasons"] == ["words"] and long["running_share"] == 1
    assert Q.judge(docs.limit(0), words).isEmpty() and Q.judge(docs, words.limit(0)).count() == 6


def test_odd_documents(spark):
    docs = [(1, PROSE * 5), (2, None), (3, ""), (4, " \n "), (5, "- a\n- b\n* c\nEnd of it…\n# #"), (6, "word " * 200_000), (7, "x" * 500_000), (1, PROSE * 5), (None, PROSE * 5)]
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id bigint, text string, n_words int, r string")
    common = spark.createDataFrame([("en", w) for w in COMMON] + [(None, None), ("en", "The ")], "lang string, word string")
    rows = sorted(Q.judge(df, common).collect(), key=str)
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["reasons"] == [] and by[1]["published_reasons"] == [] and by[1]["n_words"] == 90 and by[1]["running_share"] == 1.0
    for empty in (2, 3, 4):
        assert by[empty]["reasons"] == ["words", "word_length", "letters", "sentences"] and by[empty]["n_words"] == 0 and by[empty]["mean_word_length"] == 0.0
    five = by[5]
    assert (five["n_lines"], five["bullet_share"], five["ellipsis_share"], five["line_end_share"]) == (5, 0.6, 0.2, 0.2) and five["symbol_ratio"] == pytest.approx(3 / 11)
    assert by[6]["n_words"] == 200_000 and "words" in by[6]["published_reasons"] and by[7]["mean_word_length"] == 500_000
    assert Q.judge(spark.createDataFrame([], df.schema), common).count() == 0
    assert Q.judge(df, spark.createDataFrame([], common.schema)).count() == 9
