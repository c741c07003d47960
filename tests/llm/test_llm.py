"""Training-data operators: exact round trips, brute force, held-out cases and odd tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import align, bpe, garble, lattice, lm, lookalike, packing, pages, queries, reference, sentences, spam
from corpusmill.session import table
from tests.conftest import rows

NEEDED = {f"p{k}_found" for k in (1, 2, 3, 4, 6, 7, 10)} | {"p8_ids", "p9_packing"}


def test_queries_are_registered():
    assert NEEDED <= set(queries.queries())


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r["text"] for r in table(spark, sf_dir, "localized_nodes").where("text IS NOT NULL").select("text").collect()]


def test_bpe_equals_library(sf_dir, spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    docs = [r["text"] or "" for r in table(spark, sf_dir, "documents").select("text").collect()]
    rng = random.Random(2)
    docs += ["".join(rng.choice("ab é中🕯️'s 12\n\t‍<|endoftext|>") for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["a" * 5000, " " * 300]
    mine = bpe.load("byte_bpe_50k").encode(docs)
    want = [e.ids for e in ref.encode_batch(docs, add_special_tokens=False)]
    assert [list(x) for x in mine] == want


def test_bpe_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encode(df).collect()}
    assert {(1, ()), (2, ())} < got and len(got) == 3
    assert bpe.encode(df).count() == 4 and bpe.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [7, 50, 256])
def test_plan_uses_every_item_once(cap):
    rng = np.random.default_rng(cap)
    sizes = rng.integers(1, cap + 1, 2000)
    u, c = np.unique(sizes, return_counts=True)
    plan = packing.plan(u, c, cap)
    used: dict = {}
    for combo, n in plan:
        assert sum(combo) <= cap and n > 0
        for s in combo:
            used[s] = used.get(s, 0) + n
    assert used == dict(zip(u.tolist(), c.tolist()))
    assert sum(n for _, n in plan) <= 1.08 * np.ceil(sizes.sum() / cap) + np.sum(sizes > cap / 2) * 0.2


@pytest.mark.parametrize("cap", [256, 512, 2048, 8192])
def test_least_squares_place_most_items(cap):
    """Sizes as those of documents: many of 20 to 400 and a heavy tail. Little space stays unused, and most items are placed by the fit."""
    rng = np.random.default_rng(cap)
    sizes = np.concatenate([rng.lognormal(4.9, 0.6, 8000), rng.lognormal(6.2, 0.9, 800)]).astype(int) + 1
    sizes = np.where(sizes > cap, sizes % cap, sizes)
    u, c = np.unique(sizes[sizes > 0], return_counts=True)
    plan, placed = packing.plan_steps(u, c, cap)
    assert sum(len(x) * n for x, n in plan) == c.sum() and all(sum(x) <= cap for x, _ in plan)
    assert placed >= 0.5 * c.sum()
    assert sum(n for _, n in plan) <= 1.005 * (u * c).sum() / cap + 1


def test_least_squares_converge():
    index = np.array([[0, 0, -1], [0, 1, 2], [2, 2, 1]])
    a = np.array([[2, 0, 0], [1, 1, 1], [0, 1, 2]]).T
    x = packing.nnls(index, a @ np.array([3.0, 5.0, 2.0]))
    assert np.allclose(x, [3, 5, 2], atol=0.1)


def test_pack_is_whole(spark):
    rng = random.Random(4)
    items = [(k, rng.choice([0, 1, 3, 5, 5, 5, 9, 25, 26])) for k in range(300)] + [(7, 5), (None, 4), (900, None)]
    caps = spark.createDataFrame([(1, 10), (2, 12), (3, None)], "capacity_id int, capacity_tokens int")
    df = spark.createDataFrame(items, "doc_id long, size int").repartition(5)
    got = packing.pack(df, caps).collect()
    for cid, cap in ((1, 10), (2, 12)):
        mine = [r for r in got if r["capacity_id"] == cid]
        assert sum(r["piece_size"] for r in mine) == sum(s or 0 for _, s in items)
        fill: dict = {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["piece_size"]
        assert all(v <= cap for v in fill.values())
        assert {r["doc_id"] for r in mine} == {k for k, _ in items}
        split = {}
        for r in mine:
            if r["doc_id"] is not None and r["doc_id"] != 7:
                split.setdefault(r["doc_id"], []).append(r["piece_size"])
        sizes = {k: s for k, s in items if k != 7}
        assert all(len(v) == 1 for k, v in split.items() if (sizes[k] or 0) <= cap)
    assert packing.pack(df.limit(0), caps).count() == 0


def counts_of(texts, of):
    t = np.zeros((lm.ROWS, 1 << lm.BITS), dtype=np.float32)
    n = 0
    for x in texts:
        for u in of(x):
            for k, b in enumerate(lm.buckets(u)):
                t[k, b] += 1
            n += 1
    return lm.Counts(t, n)


@pytest.fixture(scope="module")
def restorer(texts):
    alphabet: dict = {}
    for t in texts:
        for c in t:
            if not c.isascii():
                alphabet[c] = alphabet.get(c, 0) + 1
    return garble.Restorer(counts_of(texts, garble.touched), alphabet)


def test_garbled_text_comes_back(texts, restorer):
    """Held-out round trip: clean French and German texts, garbled by each channel, are found and mostly restored."""
    clean = [t for t in texts if any(c in t for c in "éèäüö") and restorer.decode(t)[1] == 0 and lookalike.surface(t) == t and not any("Ѐ" <= c <= "ӿ" for c in t)][:40]
    assert len(clean) > 10
    found = back = total = 0
    for true, wrong in (("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251")):
        for t in clean:
            try:
                bad = t.encode(true).decode(wrong)
            except (UnicodeError, LookupError):
                continue
            total += 1
            got, n = restorer.decode(bad)
            found += n > 0
            back += got == t
    assert total > 20 and found >= 0.95 * total and back >= 0.6 * total


def test_clean_text_stays(restorer):
    for t in ("LA FÊTE À L’ÂGE", "«PIÉTÉ»", "Il 28º giorno dopo la festa.", "plain", "", "Thе teachеr"):
        assert restorer.decode(t) == (t, 0)
    assert restorer.decode("a �b")[1] == 1


def test_lost_bytes_are_read_from_a_lattice(texts, restorer):
    """Losses in Chinese and Arabic, any number of them, come back from the bytes that are left and the corpus' sequences."""
    clean = [t for t in texts if not t.isascii() and restorer.decode(t)[1] == 0]
    table = np.zeros(2 * (1 << lattice.BITS) + 1)
    lattice.add(table, clean)
    grams = lattice.Grams(table[:-1].reshape(2, -1), table[-1])
    r = garble.Restorer(restorer.counts, restorer.alphabet, lattice.Reader(grams, restorer.alphabet))
    for true, wrong, script, share in (("utf-8", "gb18030", "\u4e00\u9fff", 0.95), ("big5", "utf-8", "\u4e00\u9fff", 0.7), ("cp1256", "utf-8", "\u0600\u06ff", 0.5)):
        same = total = 0
        for t in [t for t in clean if sum(script[0] <= c <= script[1] for c in t) > 5 and len(t) < 250][:5]:
            bad = t.encode(true, "ignore").decode(wrong, "replace")
            if garble.LOST not in bad:
                continue
            got, n = r.decode(bad)
            assert n > 0
            same += sum(a == b for a, b in zip(got, t))
            total += len(t)
        assert total and same >= share * total, (true, wrong, same, total)


def _by_byte(t: str, lost: str) -> str:
    """The UTF-8 bytes of a text read as cp1252; the ones that it leaves undefined (or all continuations: "?next") come out as lost."""
    out = []
    for ch in t:
        for k, b in enumerate(ch.encode("utf-8")):
            if lost == "?next":
                out.append("?" if k else bytes([b]).decode("cp1252", "replace"))
                continue
            if lost == "control":
                out.append("" if 0x80 <= b < 0xA0 else chr(b))
                continue
            try:
                out.append(bytes([b]).decode("cp1252"))
            except UnicodeDecodeError:
                out.append(lost)
    return "".join(out)


@pytest.fixture(scope="module")
def reader():
    """A restorer with the sequences of sf0.1 without the texts that it is asked for, and these by language."""
    import pandas as pd

    n = pd.read_parquet("/root/testdata/sf0.1/localized_nodes.parquet", columns=["lang", "text"]).dropna().drop_duplicates("text").sample(frac=1, random_state=3)
    alphabet: dict = {}
    counts = counts_of(n["text"], garble.touched)
    for t in n["text"]:
        for c in t:
            if not c.isascii():
                alphabet[c] = alphabet.get(c, 0) + 1
    plain = garble.Restorer(counts, alphabet)
    some = n[(n["text"].str.len() < 160) & ~n["text"].map(str.isascii)].iloc[:1500]
    clean = some[[plain.decode(t)[1] == 0 and lookalike.surface(t) == t for t in some["text"]]]
    asked = {lang: list(g["text"][:10]) for lang, g in clean.groupby("lang")}
    held = {t for ts in asked.values() for t in ts}
    table = np.zeros(2 * (1 << lattice.BITS) + 1)
    lattice.add(table, [t for t in n["text"] if t not in held and plain.decode(t)[1] == 0])
    return garble.Restorer(counts, alphabet, lattice.Reader(lattice.Grams(table[:-1].reshape(2, -1), table[-1]), alphabet)), asked


@pytest.mark.parametrize(
    "lang,lost,share",
    [("zh", "", 0.8), ("zh", "?", 0.8), ("zh", "control", 0.6), ("ar", "", 0.6), ("ar", "?", 0.7), ("fr", "?next", 0.6), ("de", "?next", 0.6), ("es", "?next", 0.7)],
)
def test_single_lost_bytes(reader, lang, lost, share):
    """Bytes that came out as nothing or as question marks, any number of them in a text: that share of the texts comes back exactly."""
    r, asked = reader
    got = [(t, r.decode(b)) for t in asked[lang] if (b := _by_byte(t, lost)) != t]
    assert len(got) >= 5 and sum(n > 0 for _, (_, n) in got) >= 0.8 * len(got)
    assert sum(t == back for t, (back, _) in got) >= share * len(got)


def test_a_no_break_space_that_became_a_blank(reader):
    r, _ = reader
    assert r.decode("L’enfant oublie le chant, jusquâ€™Ã  ce que le fruit soit mÃ»r.")[0] == "L’enfant oublie le chant, jusqu’à ce que le fruit soit mûr."


def test_every_broken_sequence_is_filled(restorer):
    channel = next(c for c in garble.CHANNELS if c == ("utf-8", "cp1252", 1))
    assert "Ã" not in restorer.completed("rÃ?gÃ?", channel)


def test_garble_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Ã©Ã©")], "id int, text string")
    counts, alphabet = garble.corpus_counts(df)
    assert rows(df.select("id", garble.is_garbled(F.col("text"), counts, alphabet)))[0] == (1, False)
    counts, alphabet = garble.corpus_counts(df.limit(0))
    assert df.limit(0).select(garble.restored(F.col("text"), counts, alphabet)).count() == 0


def test_lookalikes():
    n = lookalike.Normalizer({"teacher": 5.0, "Москва": 3.0})
    same = ["teacher", "tеacher", "ｔｅａｃｈｅｒ", "tea​cher", "te­acher"]
    assert {n.canonical(x) for x in same} == {"teacher"}
    assert n.canonical("Мoсква") == n.canonical("Москва")
    assert n.canonical("é") == n.canonical("é") and n.canonical("a b") == n.canonical("a b")
    for a, b in (("é", "e"), ("Lamp", "lamp"), ("12", "13"), ("º", "o"), ("l", "1")):
        assert n.canonical(a) != n.canonical(b)


@pytest.mark.parametrize(
    "a,b",
    [
        ("𝐥𝐚𝐦𝐩", "lamp"), ("а\u0301", "á"), ("\u0430\u0301b", "áb"), ("la\u034fmp", "lamp"), ("օil", "oil"), ("Ꭺ", "A"), ("Ӏ", "I"), ("ℌ", "H"), ("Ⅳ", "IV"), ("ｌａｍｐ\u3000x", "lamp x"), ("oi\U000e0101l", "oil"),
        ("e\u0301te\u0301", "été"),
    ],
)
def test_characters_that_look_alike(a, b):
    n = lookalike.Normalizer({})
    assert n.canonical(a) == n.canonical(b)


def test_spellings_do_not_depend_on_the_parts(spark):
    """Words of look-alikes only get their script from the corpus; the form is the same whether one trie or several hold them."""
    texts = ["оса оса осока", "оса сено", "coca cola oca", "ос\u00e1", "lamp", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row_id int, text string")
    one = lookalike.spellings(df)
    assert len(one) == 1 and "оса" in one[0] and "lamp" not in one[0]
    many = lookalike.spellings(df, per=1)
    assert len(many) == len(one[0])
    form = lambda words: [r["f"] for r in df.select(lookalike.canonical(F.col("text"), words).alias("f")).collect()]
    assert form(one) == form(many)
    n = lookalike.Normalizer(one[0])
    assert n.canonical("oca") == n.canonical("оса") == "оса"


def test_trie_against_brute_force():
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))): 1.0 for _ in range(60)}
    trie = lookalike.Trie(words)
    for _ in range(60):
        w = "".join(rng.choice("abcа") for _ in range(rng.randint(1, 5)))
        look = lookalike.skeleton(w)
        want = min(reference.levenshtein(look, x) for x in words)
        got = trie.match(w, 2.0)
        assert (got[0] if got else 3) == min(want, 3)


def test_alike_pairs(spark):
    data = [(1, 1, "the lamp"), (2, 1, "thе lamp"), (3, 1, "thе lamp"), (4, 1, "the lamp"), (5, 2, "thе lamp"), (6, 1, "The lamp"), (7, 1, None), (None, 1, "the lаmp")]
    df = spark.createDataFrame(data, "row_id long, id int, text string").withColumn("form", F.lit("clash"))
    got = rows(lookalike.alike_pairs(df, [{"lamp": 1.0}], ["id"]))
    assert got == [(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4)]
    assert lookalike.alike_pairs(df.limit(0), [], ["id"]).count() == 0
    # one row for each with its class, instead of the pairs
    assert rows(lookalike.alike_classes(df, [{"lamp": 1.0}], ["id"])) == [(1, 1, 1, 2), (1, 2, 1, 2), (1, 3, 1, 2), (1, 4, 1, 2)]
    assert lookalike.alike_classes(df.limit(0), [], ["id"]).count() == 0


@pytest.fixture(scope="module")
def splitter(spark, sf_dir):
    return sentences.train(queries._node_texts(spark, sf_dir))


@pytest.mark.parametrize(
    "text,want",
    [
        ("The lamp burns. The oil waits.", [0, 16]),
        ("E. M. Velinna waits, i.e. 3 sacks. Is it so? Yes!", [0, 35, 45]),
        ("Duvira answers: “The child waits. The lamp burns.” The oil.", [0, 51]),
        ("門開了。燈亮了！\n油", [0, 4, 9]),
        ("Der Gast … und wartet.In der Wüste", [0, 22]),
        ("", []),
        ("  \n ", []),
    ],
)
def test_units(splitter, text, want):
    assert splitter.starts(text) == want


def test_units_on_odd_rows(spark, splitter):
    df = spark.createDataFrame([(1, None), (2, "a. " * 20000)], "id int, text string")
    got = {r["id"]: r["s"] for r in df.select("id", sentences.unit_starts(F.col("text"), splitter).alias("s")).collect()}
    assert got[1] == [] and got[2][0] == 0


def test_a_batch_gives_what_single_texts_give(splitter, texts):
    some = texts[:60] + ["", "  \n ", "a"]
    assert splitter.batch(some) == [splitter.starts(t) for t in some]


@pytest.fixture(scope="module")
def held_out():
    """A splitter of the texts of sf0.1 without 2,500 of them, and those by language."""
    import pandas as pd

    n = pd.read_parquet("/root/testdata/sf0.1/localized_nodes.parquet", columns=["lang", "text"]).dropna()
    n = n.drop_duplicates("text").sample(frac=1, random_state=4)
    test, rest = n[:2500], list(n["text"][2500:])
    counts: dict = {}
    for t in rest:
        for u in sentences.evidence(t):
            counts[u] = counts.get(u, 0) + 1
    first = sentences.Splitter(type("C", (dict,), {"__missing__": lambda self, k: 0})(counts))
    flat = [sentences.plain(t)[0] for t in rest]
    known = [(f, first.chain(f, *first.marked(f)[:2])) for f in flat]
    return sentences.Splitter(first.c, sentences.Bare.fit(known), sentences._near(known)), test


@pytest.mark.parametrize("lang,kept,recall,precision", [("zh", 0.0, 0.85, 0.85), ("fr", 0.0, 0.9, 0.88), ("la", 0.0, 0.88, 0.86), ("ar", 0.0, 0.7, 0.75), ("zh", 0.5, 0.8, 0.85), ("fr", 0.5, 0.8, 0.85), ("zh", -1, 0.85, 0.85)])
def test_boundaries_without_marks(held_out, lang, kept, recall, precision):
    """Held-out texts whose marks are taken out, all, half of them, or all but the last: the boundaries that the marks gave are found again."""
    splitter, test = held_out
    rng = random.Random(7)
    want = got = both = 0
    for t in test.loc[test["lang"] == lang, "text"]:
        if "\ufffd" in t or "\n" in t:
            continue
        starts, out, new, opens = set(splitter.starts(t)), [], set(), False
        for i, ch in enumerate(t):
            opens = opens or i in starts
            last = kept < 0 and i == len(t) - 1
            if not (ch.isalnum() or ch.isspace() or ch in "’'-_" or last or rng.random() < kept):
                continue
            if opens and not ch.isspace():
                new.add(len(out))
                opens = False
            out.append(ch)
        text = "".join(out)
        lead = len(text) - len(text.lstrip())
        found = set(splitter.starts(text)) - {lead}
        new -= {lead}
        want, got, both = want + len(new), got + len(found), both + len(new & found)
    assert want > 30 and both >= recall * want and both >= precision * got


def test_length_alignment_against_all_ways():
    """The cheapest beads of pairs of several shapes filled together, against a search of every way."""
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(3, 90, n).astype(float), rng.integers(3, 90, m).astype(float)) for n, m in [(0, 0), (0, 2), (3, 0), (1, 1), (2, 1), (4, 3), (4, 3), (5, 6)]]

    def cheapest(a, b):
        ratio = (b.sum() or 1.0) / (a.sum() or 1.0)
        memo: dict = {(0, 0): 0.0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [memo[i, j]] if (i, j) == (0, 0) else []
                for di, dj, fix in align.MOVES:
                    if i >= di and j >= dj and (di or dj):
                        x, y = a[i - di : i].sum(), b[j - dj : j].sum()
                        ways.append(memo[i - di, j - dj] + fix + (abs(np.log((y + 4) / (x * ratio + 4))) * 3 if di and dj else 0))
                memo[i, j] = min(ways)
        return memo[len(a), len(b)]

    for (a, b), found in zip(pairs, align.by_length_all(pairs)):
        assert abs(sum(c for *_, c in found) - cheapest(a, b)) < 1e-9
        assert [x for i, i2, _, _, _ in found for x in range(i, i2)] == list(range(len(a))) and [x for _, _, j, j2, _ in found for x in range(j, j2)] == list(range(len(b)))


def test_alignment_of_made_translations(spark):
    """EM on made sentences with a known dictionary: swapped, merged and left-out units are found."""
    rng = random.Random(6)
    subj, verb, obj = (["%s%d" % (p, k) for k in range(8)] for p in ("su", "ve", "ob"))
    word = lambda w: "x" + w[::-1].replace("us", "ka").replace("ev", "lo").replace("bo", "mi")
    sent = lambda: (rng.choice(subj), rng.choice(verb), rng.choice(obj))
    left = lambda s: "The %s %s the %s." % tuple(w.translate(str.maketrans("01234567", "abcdefgh")) for w in s)
    right = lambda s: "Le %s %s le %s." % tuple(word(w.translate(str.maketrans("01234567", "abcdefgh"))) for w in s)
    docs = [[sent() for _ in range(4)] for _ in range(250)]
    def hashed(us):
        h = [[align.word_hash(w) for w in align.words(u)] for u in us]
        return np.array([len(x) for x in h], dtype=np.int32), np.array([w for x in h for w in x], dtype=np.int64)

    def side(us):
        return np.array([align.size(u) for u in us]).tobytes(), *(x.tobytes() for x in hashed(us))

    both = [([left(s) for s in d], [right(s) for s in d]) for d in docs]
    names = [f"{n}_{f} binary" for n in "ef" for f in ("sizes", "counts", "words")]
    df = spark.createDataFrame([("fr", *map(bytearray, side(e)), *map(bytearray, side(f))) for e, f in both], "lang string, " + ", ".join(names))
    lex = align.train(align.beads(df).cache())
    aligned = lambda e, f: align.align(lex, "fr", hashed(e), hashed(f))
    d = docs[0] = [(subj[k], verb[k], obj[k]) for k in range(4)]
    L, R = [left(s) for s in d], [right(s) for s in d]
    assert aligned(L, R) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert set(aligned(L, [R[1], R[0], R[3]])) == {(0, 1), (1, 0), (3, 2)}
    assert set(aligned(L, [R[0], R[1][:-1] + ", et " + R[2].lower(), R[3]])) == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert aligned([], R) == [] and aligned(["..."], ["!"]) in ([], [(0, 0)])


def test_bk_tree_against_brute_force():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    tree = reference.BKTree(words)
    for _ in range(40):
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 9)))
        for limit in (1, 3):
            assert sorted(set(tree.within(q, limit))) == sorted({(reference.levenshtein(q, w), w) for w in words if reference.levenshtein(q, w) <= limit})


def test_levenshtein():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    for a, b in itertools.product(["", "a", "kitten", "sitting", "abcabc", "été"], repeat=2):
        assert reference.levenshtein(a, b) == plain(a, b)


def test_reference_mapping(spark, sf_dir):
    src = table(spark, sf_dir, "external_sources")
    refs = table(spark, sf_dir, "external_references").where("canonical_label IS NOT NULL AND label IS NOT NULL AND trim(label) <> ''")
    got = reference.match(refs, src).join(refs.select("label", "canonical_label").distinct(), "label").join(src.select(F.col("id").alias("source_id"), F.col("title")), "source_id", "left")
    right, total = got.select(F.count_if(F.col("title") == F.col("canonical_label")), F.count("*")).first()
    assert right >= 0.9 * total  # held-out: the canonical labels aren't used by the match
    odd = spark.createDataFrame([("ibid.",), ("Kitchen Almanac 3",), (" ",), (None,), ("S.Q.P. 4",), ("S.Q.P. 4",)], "label string").withColumn("source_id", F.lit("clash"))
    found = {r["label"]: r["source_id"] for r in reference.match(odd, src).collect()}
    assert found["ibid."] == found["Kitchen Almanac 3"] == "none" and found["S.Q.P. 4"].startswith("src-") and len(found) == 3
    two = {r["label"]: r["source_id"] for r in reference.match(odd, src, per_shard=100).collect()}
    assert two == found  # several trees give what one tree gives
    assert reference.match(odd.limit(0), src).count() == 0 and {r["source_id"] for r in reference.match(odd, src.limit(0)).collect()} <= {"none"}


PAGE = """<!doctype html>
<html><head><title>x</title><style>p{}</style></head><body>
<ul>
<li><a href="a.htm">Home</a></li>
<li><a href="b.htm">About</a></li>
</ul>
<h1>The lamp</h1>
<p><a name="1"></a>1 The lamp burns in the house and does not fail.</p>
<p class="ad">[ Advertisement ]</p>
<ul>
<li>One item of the body.</li>
</ul>
<p><sup>1</sup> A note</p>
<div class="box"><h3>Read also</h3>
<p>Another text. <a href="c.htm">»</a></p>
</div>
<div>
<p>All rights reserved.</p>
</div>
</body></html>"""


def test_page_body(spark):
    got = [(ln, v) for ln, _, v in pages.markup_lines(PAGE)]
    assert [ln for ln, v in got if v] == [6, 7, 10, 12]
    df = spark.createDataFrame([(1, "p", "s.example", PAGE), (2, "q", None, None), (3, "r", None, ""), (None, "t", None, "x")], "page_id long, local_path string, site string, content string").withColumn("line_no", F.lit("clash"))
    assert rows(pages.body_lines(pages.lines(df))) == [(1, 6), (1, 7), (1, 10), (1, 12)] or len(rows(pages.body_lines(pages.lines(df)))) == 4
    assert pages.body_lines(pages.lines(df.limit(0))).count() == 0
    assert "The lamp" in pages.render(PAGE) and "p{}" not in pages.render(PAGE) and "- One item" in pages.render(PAGE)
    assert pages.render("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>") == "a    bb\nccc  d"


def test_rendering():
    page = "<h1>T</h1><p>one<br>two <b>bold</b><ul><li>a<li>b</ul><table><tr><td>x<td>long cell<tr><td>wide<td>y</table><div style='display: none'>no</div><table><tr><td><p>laid out</p><td><h2>beside</h2></table>"
    assert pages.render(page) == "T\n\none\ntwo bold\n\n- a\n- b\n\nx     long cell\nwide  y\n\nlaid out\n\nbeside"
    assert pages.render("plain <text>") == "plain <text>" and pages.render("<p></p>") == ""


def test_body_as_text(spark):
    df = spark.createDataFrame([(1, "p", "s", PAGE), (2, "q", "s", None), (3, "r", "s", "")], "page_id long, local_path string, site string, content string")
    found = pages.lines(df)
    text = {r["page_id"]: r["text"] for r in pages.body_text(found, pages.body_lines(found)).collect()}
    assert text == {1: "The lamp\n\n1 The lamp burns in the house and does not fail.\n\n- One item of the body.\n\n1 A note"}


def test_titles_of_links_do_not_remove_headings(spark):
    """A heading of the body that other pages' boxes link to stays; a notice that they show as chrome goes."""
    body = "<body><main>\n<h2>The elder proclaims hope</h2>\n<p>The lamp burns in the house and does not fail.</p>\n<p>All rights reserved.</p>\n</main></body>"
    other = '<body><div class="box"><ul>\n<li><a href="a.htm">The elder proclaims hope</a></li>\n<li><a href="b.htm">Home</a></li>\n</ul></div>\n<main><p>Text of page number %s that is long enough.</p></main>\n<footer><p>All rights reserved.</p></footer></body>'
    data = [(1, "p1", "s.example", body)] + [(k, f"p{k}", site, other % ("abcdefghijkl"[k])) for k, site in zip(range(2, 10), ["s.example", "t.example"] * 4)]
    df = spark.createDataFrame(data, "page_id long, local_path string, site string, content string")
    assert [ln for pid, ln in rows(pages.body_lines(pages.lines(df))) if pid == 1] == [1, 2]


def test_long_page_is_linear():
    big = "<body>" + "<p>A line of the body that is long enough.</p>\n" * 20000 + "</body>"
    assert len(pages.markup_lines(big)) == 20000


@pytest.mark.parametrize(
    "text,is_spam",
    [
        ("candles incense candles candles medals incense medals candles incense candles medals candles incense " * 2, True),
        ("\n".join(f"http://shop.example/{k}" for k in range(12)), True),
        ("\n".join(f"Candles: {k}.50 ★★★★☆ [cart] AB{k}" for k in range(12)), True),
        ("Our lamp shop sells lamp for lamp lovers. Lamp here, lamp there, lamp for all who love lamp. " * 4, True),
        ("The door is open.\n\n" + " | ".join(f"candles {p}" for p in ("Karsk", "Thale", "Menth") * 5), True),
        ("The table, the elder.\nWhere two roads meet.\n" * 8, False),
        ("\n".join(f"the lamp, {k}, {k + 80}–{k + 120}" for k in range(12)), False),
        ("A box of candles was left at the door, see https://ikon24.test/3492. The council guards the covenant.", False),
        ("........", False),
        ("", False),
    ],
)
def test_spam(text, is_spam):
    m = spam.Model.stated()
    obs = spam.symbols(text)
    states = m.viterbi([s for s, _ in obs])
    total = sum(w for _, w in obs)
    share = sum(w for s, (_, w) in zip(states, obs) if s) / total if total else 0.0
    assert (share > spam.SHARE) == is_spam


def test_spam_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c. " * 30000), (None, "x"), (3, "a b c. ")], "doc_id long, text string").withColumn("symbols", F.lit("clash"))
    seen = spam.observe(df).cache()
    assert sorted(r["id"] for r in spam.shares(seen, spam.train(seen)).collect()) == [1, 2, 3, 3]
    none = spam.observe(df.limit(0))
    assert spam.shares(none, spam.train(none)).count() == 0


def test_forward_backward_against_all_paths():
    """Expected counts and the likeliest path of several documents at once, against every path of each."""
    m = spam.Model.stated()
    docs = [[0, 7, 7, 10], [], [9], [5, 5, 0]]
    emitted, moved, first = m.expected_all(docs)
    want = [np.zeros_like(x) for x in (emitted, moved, first)]
    paths = []
    for obs in docs:
        ways = {}
        for way in itertools.product(range(len(spam.STATES)), repeat=len(obs)):
            p = 1.0
            for t, (s, o) in enumerate(zip(way, obs)):
                p *= (m.start[s] if not t else m.move[way[t - 1], s]) * m.emit[s, o]
            ways[way] = p
        paths.append(max(ways, key=ways.get))
        for way, p in ways.items() if obs else ():
            p /= sum(ways.values())
            want[2][way[0]] += p
            for t, (s, o) in enumerate(zip(way, obs)):
                want[0][s, o] += p
                if t:
                    want[1][way[t - 1], s] += p
    assert all(np.allclose(a, b) for a, b in zip((emitted, moved, first), want))
    assert [tuple(x.tolist()) for x in m.viterbi_all(docs)] == paths


@pytest.mark.parametrize("name", sorted(NEEDED))
def test_query_runs(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    want = {"p1_found": ["rec_kind", "rec_id"], "p2_found": ["ref_key", "source_id"], "p3_found": ["id", "lang", "node_start", "loc_start"], "p4_found": ["page_id", "line_no"], "p6_found": ["rec_kind", "row_id_a", "row_id_b"], "p7_found": ["rec_kind", "row_id", "sent_start"], "p10_found": ["doc_id"], "p8_ids": ["doc_id", "ids"]}
    if name in want:
        assert df.columns == want[name]
    got = df.collect()
    if name != "p8_ids":
        assert len(got) == len({tuple(r) for r in got})
