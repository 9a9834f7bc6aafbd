import random
import unicodedata

import numpy as np
import pytest

from gatewright.llm import leakage as L

WORDS = "amber basket candle dragon ember forest garden harbour island jungle kettle lantern meadow north ocean pepper quarry river saddle tunnel umbrella valley window yellow zebra".split()


def brute(docs, items, n=13):
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = L.fold(item).split(), f" {L.fold(text)} "
            if any(f" {' '.join(a[k : k + n])} " in b for k in range(len(a) - n + 1)):
                out.add((d, i))
    return out


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id bigint, text string, item_id string, __gw_text int") if options.pop("clash", False) else spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [tuple(r) for r in L.leaks(d, i, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed):
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, sentence(rng.randint(5, 60))) for i in range(30)]
    docs = []
    for d in range(120):
        text = sentence(rng.randint(0, 80))
        if d % 3:
            words = rng.choice(items)[1].split()
            n = rng.choice([11, 12, 13, 14, 25])
            at = rng.randint(0, max(0, len(words) - n))
            piece = words[at : at + n]
            if d % 4 == 1 and len(piece) > 6:
                piece[6] = piece[6][:-1]  # one edit
            text += " " + " ".join(piece) + " " + sentence(rng.randint(0, 20))
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("edits", [0, 1, 3])
def test_against_brute_force(spark, seed, edits):
    docs, items = corpus(seed)
    want = brute(docs, items)
    assert want and found(spark, docs, items, edits=edits) == want


def test_blocks_of_items(spark):
    docs, items = corpus(7)
    assert found(spark, docs, items, block_chars=300) == brute(docs, items)
    assert found(spark, docs, items, block_chars=300, pass_chars=700) == brute(docs, items)


def distance(a, b):
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("edits", [1, 2])
def test_edited_passages_are_found_by_alignment(spark, edits):
    rng = random.Random(edits)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(3)]
    docs = []
    for d in range(30):
        words = rng.choice(items)[1].split()
        at = rng.randint(0, 40 - 16)
        passage = list(" ".join(words[at : at + 16]))
        for _ in range(d % 5):
            place = rng.randrange(len(passage))
            passage[place] = rng.choice("qxz") if rng.random() < 0.5 else ""
        docs.append((d, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 5))) + " " + "".join(passage) + " " + " ".join(rng.choice(WORDS) for _ in range(3))))
    got = {(r["doc_id"], r["item_id"]) for r in L.near_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=edits).collect()}
    want = set()
    for d, text in docs:
        for i, item in items:
            w = item.split()
            if any(distance(" ".join(w[k : k + 13]), L.fold(text)) <= edits for k in range(28)):
                want.add((d, i))
    assert len(want) > 8 and len(got & want) >= 0.95 * len(want) and brute(docs, items) <= got
    # what is found beyond is close too
    assert all(any(distance(" ".join(dict(items)[i].split()[k : k + 13]), L.fold(dict(docs)[d])) <= 2 * edits + 1 for k in range(28)) for d, i in got - want)


def test_an_instruction_shared_by_all_items():
    """2 000 items begin alike; a page that repeats the beginning gives no flood of hits."""
    import tracemalloc

    rng = random.Random(3)
    shared = " ".join(rng.choice(WORDS) for _ in range(30))
    items = [(i, f"{shared} " + " ".join(f"{rng.choice(WORDS)}{rng.randrange(999)}" for _ in range(20))) for i in range(2_000)]
    index = L.Index(items, L.Q, L.EDITS, L.MIN_WORDS)
    text = " ".join([shared, "x"] * 200) + " " + items[7][1]
    tracemalloc.start()
    numbers = set()
    for doc, item, lowest, met, first, last in index.regions(text, np.array([0])):
        numbers |= {n for n, _ in index.verified(item, text, lowest, met, first, last, 0, len(text), exact=True)}
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert {o for n in numbers for o in index.owners[n]} == set(range(2_000))
    assert max(len(a) for a, _, _ in index.seeded(L._hashes(L._codes(text), L.Q))) <= L.HIT_BLOCK


def test_folding():
    text = "The Ca­fé’s \"naïve\"\n\tﬁne—Straße, ２０２６ ИЙ​й Ελλάδα"
    assert L.fold(text) == "the cafe s naive fine strasse 2026 иии ελλαδα"
    assert L.fold(None) == L.fold("") == L.fold(" \n…") == ""


def test_disguises_ends_and_near_misses(spark):
    passage = "When the old garden closed its gates, nobody near the river could say why it stayed silent"
    words = passage.split()
    decomposed = unicodedata.normalize("NFD", passage.replace("e", "é"))
    docs = [
        (1, passage), (2, "x " + passage.upper() + " y"), (3, "…" + "\n".join(words) + "!"), (4, decomposed), (5, " ".join(w[0] + "​" + w[1:] for w in words)),
        (6, " ".join(words[:12])), (7, " ".join(words[:13])), (8, " ".join(["a" + words[0], *words[1:13]])), (9, " ".join([*words[1:13], words[13] + "x"])), (10, " ".join([*words[:6], "very", *words[6:13]])),
        (11, " ".join([words[0] + "z", *words[1:]])), (12, None), (13, ""), (14, "…"), (1, passage), (15, " ".join(words[-13:])),
    ]
    items = [(1, passage), (2, "too short to leak"), (3, None), (4, ""), (1, passage), (None, passage)]
    assert found(spark, docs, items, clash=True) == {(d, 1) for d in (1, 2, 3, 4, 5, 7, 11, 15)}


def test_very_long_documents(spark):
    docs, items = corpus(2)
    passage = max((t for _, t in items), key=len)
    item = next(i for i, t in items if t == passage)
    filler = " ".join(random.Random(5).choice(WORDS) for _ in range(400_000))
    # the passage lies across the place where pieces are cut
    for cut in (L.PIECE_CHARS - 200, L.PIECE_CHARS, 2 * L.PIECE_CHARS - 100):
        at = filler.rfind(" ", 0, cut)
        assert (1, item) in found(spark, [(1, filler[:at] + " " + passage + filler[at:])], items)
    assert found(spark, [(1, "a" * 3_000_000)], items) == set()


def test_empty_tables_and_bad_q(spark):
    assert found(spark, [], [(1, "x " * 20)]) == set() == found(spark, [(1, "x " * 20)], [])
    with pytest.raises(ValueError):
        found(spark, [(1, "x")], [(1, "x")], q=12)
