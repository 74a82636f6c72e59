import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmend.llm import common, line_dedup, simhash, unit_dedup

SF = "/root/testdata/sf0.001"


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closure(600, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts():
    base = [f"w{i}" for i in range(400)]
    out = [" ".join(base)] * 3
    for k in range(120):
        out.append(" ".join([*base[:k], "changed", *base[k + 1 :]]))
    return out


def test_simhash_against_all_pairs(spark, odd, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SMALL", 8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(near_texts(), 50_000)), "doc_id long, text string"))
    rows = docs.collect()
    fps = np.array([simhash.fingerprint(None if r.text is None else r.text.encode()) for r in rows], np.uint64)
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    comp = closure(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(close[i, :i])])
    first = defaultdict(list)
    for r, c in zip(rows, comp, strict=True):
        first[c].append(r.doc_id)
    least = {c: min((x for x in ids if x is not None), default=None) for c, ids in first.items()}
    want = Counter((r.doc_id, int(f.view(np.int64)), least[c]) for r, f, c in zip(rows, fps, comp, strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.group_documents(docs).collect()) == want
    kept = simhash.one_per_group(docs).collect()
    assert len(kept) == len(first) and {r.doc_id for r in kept} == set(least.values())


def test_fingerprints():
    from xxhash import xxh64_intdigest

    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint("Éa B".encode()) == xxh64_intdigest("Éa b".encode(), 42)


def test_simhash_rows(odd, none, clashing):
    assert simhash.group_documents(none).count() == 0 and simhash.one_per_group(none).count() == 0
    assert simhash.group_documents(clashing).count() == odd.count() and simhash.one_per_group(clashing).columns == clashing.columns


def kept_lines(texts):
    """The earliest occurrence of each unit stays; texts are in rank order, equal ones are one document."""
    seen, out = {}, []
    for k, t in enumerate(texts):
        lines = []
        for i, line in enumerate((t or "").split("\n")):
            n = unit_dedup.normalise(line) or unicodedata.normalize("NFKC", line).strip()
            if not n or seen.setdefault(n, (k, i)) == (k, i):
                lines.append(line)
        out.append("\n".join(lines))
    return out


def test_unit_dedup(spark, odd, none, clashing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text for r in docs] + ["Ünïque, passage number ONE of two copies\nx\n", "x\n ünïque passage number one of two copies!\ntail"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in unit_dedup.dedup_documents(table).collect()}
    for i, want in enumerate(kept_lines(texts)):
        spans = [(s.start, s.end) for s in got[i].removed]
        # the text is the original without the spans, byte for byte, and the spans are whole lines with their ends
        assert got[i].text == "".join(texts[i][a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(texts[i])], strict=True))
        assert Counter(texts[i][a:b].removesuffix("\n") for a, b in spans) == Counter(texts[i].split("\n")) - Counter(want.split("\n"))
    assert unit_dedup.dedup_documents(none).count() == 0
    assert unit_dedup.dedup_documents(odd).count() == odd.count() == unit_dedup.dedup_documents(clashing).count()


def test_line_ends_stay(spark):
    dup = "a line of some words that two texts hold"
    texts = [dup, f"x\n\n{dup}\n", f"{dup}\ntail line here\n\n", f"head\n{dup}", f"{dup}\n\n{dup}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in unit_dedup.dedup_documents(docs).collect()} == {0: dup, 1: "x\n\n", 2: "tail line here\n\n", 3: "head\n", 4: "\n"}


def test_passages(spark):
    # six lines of 4 words repeat in a row, one of them alone elsewhere
    lines = [f"part{i} of the passage" for i in range(6)]
    texts = ["\n".join(["own line one", *lines, "own end"]), "\n".join(["other start", *lines[:3], "", *lines[3:]]), f"alone\n{lines[2]}\nends", "这是一个没有空格的句子，也会重复出现，而且足够长。\n终", "x\n这是一个没有空格的句子，也会重复出现，而且足够长。"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_shared) for r in unit_dedup.dedup_documents(docs, min_passage=20).collect()}
    assert got == {0: (texts[0], 6), 1: ("other start\n\n", 6), 2: (texts[2], 0), 3: (texts[3], 1), 4: ("x\n", 1)}


def test_passages_inside_lines(spark):
    # the passage stands in the midst of longer lines; sentences that many texts hold don't make a passage of their own order
    passage = " ".join(f"Sentence number {w} of the copied passage goes here." for w in ("one", "two", "three", "four", "five", "six", "seven"))
    short = ["Of the many.", "And so on.", "That is it.", "Not for us.", "Here we are.", "Who knows that.", "As it was.", "So be it."]
    texts = [f"First holder begins. {passage} It ends so.\nLast line.", f"Another text has more words. {passage} Something else! And 3.14 is kept."]
    texts += [" ".join(short[i:] + short[:i]) if i % 2 else " ".join(reversed(short[i:] + short[:i])) for i in (0, 3)]
    texts += ["And so on. Here we are. Own words. " + f"So be it. {passage} Who knows that."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in unit_dedup.dedup_documents(docs, "sentence", 20).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == t.replace(passage + " ", "") if i in (1, 4) else got[i].text == t
        assert got[i].n_shared == (7 if passage in t else 0), i
        spans = [(s.start, s.end) for s in got[i].removed]
        assert got[i].text == "".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)], strict=True))
    assert all(r.n_shared == 0 for r in unit_dedup.dedup_documents(docs, "line", 20).collect())


def test_paragraphs():
    text = "one two three\nfour five six\n\nseven eight nine ten eleven"
    assert [text[a:b].removesuffix("\n") for a, b, *_ in unit_dedup.units_of(text, "paragraph")] == text.split("\n\n")


def five(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def alike(x, y):
    """Jaccard of the sets of 5-character shingles, if the places' ratio reaches 0.8."""
    places = sorted(max(1, len(z) - 4) for z in (x, y))
    a, b = five(x), five(y)
    return len(a & b) / len(a | b) if places[0] >= 0.8 * places[1] else 0


def brute_removed(spark, docs):
    """Lines removed when every pair of distinct lines is compared."""
    rows = line_dedup.line_rows(docs, F.col("doc_id").isNull().alias("no_id"), common.id_key().alias("id0"), common.text_hash().alias("hash")).distinct().collect()
    texts = sorted({r.line for r in rows})
    at = {t: i for i, t in enumerate(texts)}
    by, links = defaultdict(set), set()
    for i, t in enumerate(texts):
        for x in five(t):
            by[x].add(i)
    for i, t in enumerate(texts):
        s = five(t)
        for j, c in Counter(j for x in s for j in by[x] if j < i).items():
            if c >= 0.4 * len(s) and alike(t, texts[j]) >= 0.8:
                links.add((i, j))
    comp = closure(len(texts), links)
    first = {}
    for r in sorted(rows, key=lambda r: (r.no_id, r.id0, r.hash, r.line_no)):
        first.setdefault(comp[at[r.line]], (r.id0, r.hash, r.line_no))
    return {(r.id0, r.hash, r.line_no) for r in rows} - set(first.values())


@pytest.mark.parametrize("block", [4, 64])
def test_fuzzy_lines(spark, monkeypatch, block):
    # lists of more than ``block`` members go through blocks of it
    monkeypatch.setattr(line_dedup, "SET_BLOCK", block)
    base = [f"alpha{i}beta" for i in range(60)]
    near = [" ".join([*base[:k], "zzz", *base[k + 1 :]]) for k in range(0, 60, 2)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(near, 70_000)), "doc_id long, text string"))
    want = brute_removed(spark, docs)
    got = removed(docs)
    assert len(want) > 30 and not got - want and len(got) >= 0.98 * len(want)


def test_fuzzy_line_rows(odd, none, clashing):
    assert line_dedup.mark_documents(none).count() == 0
    got = line_dedup.mark_documents(odd).collect()
    assert len(got) == odd.count() and sorted(len(r.removed) for r in got if r.doc_id == 5) == [0, 1, 1]
    out = line_dedup.dedup_documents(clashing)
    assert out.columns == clashing.columns and out.count() == odd.count()
    assert {r.text for r in out.where("doc_id = 5").collect()} >= {"\n   \nshort"}


def removed(docs):
    return {(r.id0, r.hash, n) for r in line_dedup.removed_lines(docs).collect() for n in r.removed}


def test_long_lists_are_compared_completely(spark, monkeypatch):
    # one list of 100 lines: interlinked clusters whose members match different first representatives
    monkeypatch.setattr(line_dedup, "entries_of", lambda signed: signed.groupBy("lk").agg(F.min("sig").alias("sig")).withColumn("key", F.lit(1)))
    for name, value in (("BLOCK", 16), ("SET_BLOCK", 16), ("APART", 80)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = np.random.default_rng(5)
    texts = []
    for c in range(5):
        words = [f"c{c}w{i}xyz" for i in range(40)]
        for _ in range(20):
            texts.append(" ".join(words))
            words = [*words]
            for k in rng.integers(0, 40, 2):
                words[k] = f"new{rng.integers(1_000_000)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_removed(spark, docs)
    assert len(want) > 50
    assert removed(docs) == want


def test_lists_of_unlike_lines_need_no_texts(spark, monkeypatch):
    # one list of lines that share some shingles by chance: few of them are held against each other, in short lists and long ones
    monkeypatch.setattr(line_dedup, "entries_of", lambda signed: signed.groupBy("lk").agg(F.min("sig").alias("sig")).withColumn("key", F.lit(1)))
    asked, texts = [], line_dedup._texts
    monkeypatch.setattr(line_dedup, "_texts", lambda docs, lks: asked.append(lks.distinct().count()) or texts(docs, lks))
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcde"), 3)) for _ in range(60)]
    lines = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    lines.append(lines[7][:-2] + "zz")
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for size in (64, 1024):
        monkeypatch.setattr(line_dedup, "SET_BLOCK", size)
        assert {r.id0 for r in line_dedup.removed_lines(docs).collect()} == {300}
    assert sum(asked) < 40, asked


def test_pairs_are_compared_in_rounds(spark, monkeypatch):
    # one list, drifting copies in clusters: rounds of bounded size, and no pair again that an earlier round has joined
    monkeypatch.setattr(line_dedup, "entries_of", lambda signed: signed.groupBy("lk").agg(F.min("sig").alias("sig")).withColumn("key", F.lit(1)))
    for name, value in (("APART", 80), ("ROUND", 60)):
        monkeypatch.setattr(line_dedup, name, value)
    sizes, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, docs: sizes.append(pairs.count()) or verified(pairs, docs))
    rng = np.random.default_rng(9)
    texts = []
    for c in range(2):
        words = [f"c{c}w{i}xyz" for i in range(40)]
        for _ in range(12):
            texts.append(" ".join(words))
            words = [*words]
            for k in rng.integers(0, 40, 2):
                words[k] = f"new{rng.integers(1_000_000)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(docs) == brute_removed(spark, docs)
    assert len(sizes) > 2 and max(sizes[1:]) <= 2 * 60 and sum(sizes[1:]) < 24 * 23 / 2, sizes


def test_families_of_edited_copies(spark, monkeypatch):
    # one list of copies of a line, each with a seventh of its words changed: hardly any are similar, and few pairs get as far as their texts
    monkeypatch.setattr(line_dedup, "entries_of", lambda signed: signed.groupBy("lk").agg(F.min("sig").alias("sig")).withColumn("key", F.lit(1)))
    monkeypatch.setattr(line_dedup, "APART", 80)
    sizes, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, docs: sizes.append(pairs.count()) or verified(pairs, docs))
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(60):
        words = [f"w{i}xyz" for i in range(42)]
        for k in rng.choice(42, 6, replace=False):
            words[k] = f"new{rng.integers(1_000_000)}"
        texts.append(" ".join(words))
    texts.append(texts[30][:-2] + "zz")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removed(docs) == brute_removed(spark, docs)
    assert sum(sizes[1:]) < 100, sizes  # of 1,830


def test_recall_does_not_depend_on_length(spark):
    # pairs of Jaccard 0.8 to 0.87 by the length of the line, by the share that has a common key and close bits
    rng = np.random.default_rng(3)
    letters, lengths, trials, pairs = list("abcdefghijklmnopqrstuvwxyz    "), (14, 30, 45, 60, 80, 150, 300, 600, 1300), 100, []
    for n in lengths:
        while len(pairs) % trials or not pairs or len(pairs[-1][0]) != n:
            x = "".join(["q", *rng.choice(letters, n - 2), "q"])
            places = rng.integers(0, n, max(1, round(n * 0.02))) if n > 40 else [n - 1]
            y = "".join("#" if i in places else c for i, c in enumerate(x))
            if 0.8 <= alike(x, y) <= (0.87 if n > 45 else 0.95):
                pairs.append((x, y))
    lines = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "lk long, line string")
    keys, bits = defaultdict(set), {}
    for r in line_dedup.entries_of(line_dedup.signatures(lines)).collect():
        keys[r.lk].add(r.key)
        bits[r.lk, r.key] = r.sig
    close = lambda i, k: (bits[2 * i, k] ^ bits[2 * i + 1, k]).bit_count() <= line_dedup.APART
    found = [any(close(i, k) for k in keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs))]
    for at, n in enumerate(lengths):
        assert sum(found[at * trials : (at + 1) * trials]) >= 0.97 * trials, n


def test_small_edits_are_found(spark):
    # lines of 10 to 20 words with one other character, and of 20 words with one other word
    rng = np.random.default_rng(7)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 5)))
    pairs = []
    for n in range(10, 21):
        for _ in range(5):
            line = " ".join(word() for _ in range(n))
            k = int(rng.integers(1, len(line) - 1))
            pairs.append((line, line[:k] + "#" + line[k + 1 :]))
    for _ in range(10):
        words = [word() for _ in range(20)]
        k = int(rng.integers(1, 19))
        pairs.append((" ".join(words), " ".join([*words[:k], word(), *words[k + 1 :]])))
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    found = {r.id0 for r in line_dedup.removed_lines(docs).collect()}
    assert found <= {2 * i + 1 for i in range(len(pairs))} and len(found) >= 0.97 * len(pairs)


def test_lines_of_any_length_take_part(spark):
    texts = ["all rights reserved.\n\nab", "x\nAll rights reserved.\n", "ab\n \n这是一个没有空格的句子，也会重复出现。", "这是一个没有空格的句子，也会重复出现。\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.mark_documents(docs).collect()}
    assert got == {0: [], 1: [1], 2: [0], 3: [0, 1]}


def test_short_units_lose_repeats(spark):
    texts = ["这是一个没有空格的句子，也会重复出现。\nMenu\n---\n \n***", "menu\n这是一个没有空格的句子，也会重复出现。\nend", "---\n \nend."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (len(r.removed), r.text) for r in unit_dedup.dedup_documents(docs).collect()}
    assert got == {0: (0, texts[0]), 1: (2, "end"), 2: (2, " \n")}


def test_any_five_positions_hold_a_list():
    from itertools import combinations

    assert len(simhash.QUADS) == 14
    assert all(any(set(q) <= set(five_) for q in simhash.QUADS) for five_ in combinations(range(8), 5))


def test_columns_of_any_name_pass(spark):
    from gridmend.llm import decontaminate, toxicity

    names = ["__id", "__hash", "a.b", "removed", "toxicity", "id0", "hash", "column 1", "we`ird"]
    text = "the same line of a text that is long enough\nand more"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + "\nother words that are new"), (3, None), (None, "")], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    items = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    model = toxicity.Model(np.zeros(toxicity.DIMS, np.float32), -1.0, 0.1)
    for name, out in (
        ("lines", line_dedup.dedup_documents(docs)), ("simhash", simhash.one_per_group(docs)),
        ("decontamination", decontaminate.clean_documents(docs, items)), ("toxicity", toxicity.clean_documents(docs, model)),
    ):
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all(r[2:] == tuple(f"kept {n}" for n in names) for r in rows), name
        assert len(rows) == (len({(r.doc_id, r.text) for r in docs.collect()}) - 1 if name == "simhash" else 5), name
