"""The models against walks by hand, and the pipeline stage by stage against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import bpe, decontaminate, quality_rules, quality_trees, text_stats, toxicity
from foliant.llm.entries import TOKENIZERS
from foliant.llm.near_dedup import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def some_text(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "red", "Blue", "tree,", "house", "walks.", "über", "x1", "#"]) + rng.choice(["", "", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(150):
        t, bad = some_text(rng, rng.randint(25, 80)), i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t))
        labels.append((i, int(not bad), 0))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def frame(spark, rows):
    """Repeated rows, and columns whose names the operators use themselves."""
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    return table.withColumn("score", F.lit("x")).withColumn("x", F.lit(1)).withColumn("y", F.lit(2)).withColumn("probability", F.lit(3)).withColumn("n_words", F.lit(4))


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, LONG), (904, "z" * 20_000), (905, "a\nb\na\n" * 50), (None, "some words"), (906, "twice the same row"), (906, "twice the same row")]


def test_trees_are_walked_alike(spark, labelled):
    rows, labels = labelled
    table = frame(spark, [*rows, *ODD])
    forest = quality_trees.fit(table, labels, "quality")
    got = quality_trees.score_quality(table, forest).collect()
    assert len(got) == len(rows) + len(ODD)
    texts = dict(rows + ODD)
    for r in got[:60] + got[-len(ODD) :]:
        x = text_stats.features((texts[r.doc_id] or "").encode(), Words())
        total = forest.start
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
    assert len({r.score for r in got if r.doc_id == 906}) == 1
    assert quality_trees.classify(table.limit(0), labels).collect() == []


def test_statistics_by_hand():
    rng = random.Random(2)
    for text in [some_text(rng, 40), "A b\nA b\n\nc, d! e", "é ü ß", LONG[:5_000], "x"]:
        got = text_stats.features(text.encode(), Words())
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        sizes = [len(w.encode()) for w in words]
        counts = [words.count(w) for w in set(words)]
        want = {
            0: sum("a" <= c <= "z" for c in text) / len(text), 1: sum("A" <= c <= "Z" for c in text) / len(text), 2: sum("0" <= c <= "9" for c in text) / len(text), 4: text.count("\n") / len(text),
            12: np.log1p(len(words)), 13: np.mean(sizes), 14: np.std(sizes), 15: np.log1p(max(sizes)), 16: len(set(words)) / len(words), 17: max(counts) / len(words), 18: counts.count(1) / len(counts),
            19: len({*zip(words, words[1:])}) / max(1, len(words) - 1), 20: len(set(lines)) / len(lines), 21: len(words) / len(lines), 22: np.mean([w[-1] in "#*$%&|<>" for w in words]), 24: np.mean(["A" <= w[0] <= "Z" for w in words]), 25: np.mean([s == 1 for s in sizes]),
        }
        for i, v in want.items():
            assert abs(got[i] - v) < 1e-4, (i, text[:40])


def rule_counts(text):
    space = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in space:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(space):
            dup += line in lines
            lines.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rules_by_hand(spark, labelled):
    rows, labels = labelled
    rng = random.Random(7)
    more = [(2_000 + i, "\n".join(some_text(rng, rng.choice((3, 9))) for _ in range(4)) + "\n" + " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    table = frame(spark, [*rows[:30], *more, *ODD])
    model = quality_rules.fit(frame(spark, rows), labels)
    texts = dict([*rows, *more, *ODD])
    got = quality_rules.judge(table, model).collect()
    assert len(got) == 30 + 40 + len(ODD)
    for r in got:
        want = rule_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed) and r.kept == (not r.base_failed and r.probability >= 0.5)
    # the probability of one text, gram by gram
    text = rows[1][1].encode()
    words, bits = text.split(), quality_rules.Rules().bits
    known, one = Words(), lambda x: np.array([x], np.uint64)
    families = [{}, {}]
    with np.errstate(over="ignore"):
        h = [one(known[w]) for w in words]
        for x in [*h, *(quality_rules.mix64(a * np.uint64(0x9E3779B97F4A7C15) + b) for a, b in zip(h, h[1:]))]:
            k = int(x[0]) >> 64 - bits
            families[0][k] = families[0].get(k, 0) + 1
    for i in range(len(text) - 2):
        k = ((text[i] << 16 | text[i + 1] << 8 | text[i + 2]) * 0x9E3779B1 % 2**32) >> 32 - bits
        families[1][k] = families[1].get(k, 0) + 1
    z = model.bias + sum(float(model.weights[k + (part << bits)]) * (n / sum(f.values())) ** 0.5 for part, f in enumerate(families) for k, n in f.items())
    p = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
    assert abs(p - next(r.probability for r in got if r.doc_id == 1)) < 1e-4
    assert quality_rules.judge(table.limit(0), model).collect() == []


def test_odd_rows_elsewhere(spark):
    """Empty tables, repeated rows, very long texts and clashing columns for the operators that read texts."""
    table = frame(spark, ODD).withColumn("ids", F.lit(0)).withColumn("spans", F.lit("s")).withColumn("items", F.lit("i"))
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(table, path).collect()}
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids for i, t in ODD}
    assert got == {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()}
    assert bpe.encode_documents(table.limit(0), path).collect() == []
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[500:520])), (None, "x"), (2, None)], "item_id long, text string").withColumn("spans", F.lit(1))
    leaks = decontaminate.find_leaks(table, bench).collect()
    assert len(leaks) == len(ODD) and {r.doc_id for r in leaks if r.spans} == {903}
    assert decontaminate.find_leaks(table.limit(0), bench).collect() == [] and all(not r.spans for r in decontaminate.find_leaks(table, bench.limit(0)).collect())
    assert decontaminate.decontaminate(table, bench).columns == table.columns


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Tables with planted cases: toxic texts, lines of many sources, near copies, benchmark passages; nulls, repeats, long texts."""
    rng, root = random.Random(21), tmp_path_factory.mktemp("world")
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3_000)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    note = "This site uses notes that are the same everywhere."
    rows, labels = [], []
    for i in range(200):
        bad = i % 2
        t = plain(rng.randint(40, 120)).split()
        for _ in range(4 * bad):
            t[rng.randrange(len(t))] = rng.choice(["vilest", "vermin", "scumbag", "rotter"])
        rows.append((i, " ".join(t), f"s{i % 15}"))
        labels.append((i, 1, bad))
    items = [(k, plain(30)) for k in range(4)]
    for i in range(200, 260):
        rows.append((i, plain(60) + (f"\n{note}" if i % 2 else "") + "\n" + plain(20), f"s{i % 15}"))
    for i in range(260, 290):
        w = rows[i - 60][1].split(" ")
        w[-1] = "ending"
        rows.append((i, " ".join(w), "s1"))
    rows += [(300 + k, plain(80) + " " + t + " " + plain(10), "s2") for k, t in items] + [(310, items[0][1] + " and", "s3")]
    rows += [(320, None, "s1"), (321, "", None), (322, plain(12_000), "s4"), (None, plain(30), "s5"), (323, rows[200][1], "s6"), (200, rows[200][1], rows[200][2])]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).withColumn("gone", F.lit("kept")).withColumn("rows", F.lit(1))
    docs.repartition(3).write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{root}/benchmark.parquet")
    return f"file://{root}", rows, items, note


def by_id(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_pipeline_stage_by_stage(spark, world):
    root, rows, items, note = world
    at = {0: spark.read.parquet(f"{root}/documents.parquet")}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at[k + 1] = stage(spark, at[k], root).cache()
        if k < 4:
            assert at[k + 1].columns == at[0].columns
    # toxicity: what the fitted network scores at the limit or over goes
    net = toxicity.fit(at[0], spark.read.parquet(f"{root}/labels.parquet"))
    scores = toxicity.Scorer(net).score((t or "").encode() for _, t, _ in rows)
    kept = [(i, t) for (i, t, _), s in zip(rows, scores, strict=True) if s < 0.7]
    assert by_id(at[1]) == sorted(kept, key=repr)
    toxic = {i for i in range(200) if i % 2}
    left = {i for i, _ in kept}
    assert len(toxic - left) >= 95 and len(left - toxic) >= 0.8 * len({i for i, _, _ in rows} - toxic)
    # line dedup
    docs = [(r.doc_id, r.text, r.source) for r in at[1].collect()]
    sites, first = {}, {}
    for i, t, s in docs:
        for p, line in enumerate((t or "").split("\n") if t is not None else ()):
            key = line.strip(" ")
            if len(key) >= 20:
                sites.setdefault(key, set()).add(s or "")
                place = (i is None, i or 0, p)
                first[key] = min(first.get(key, place), place)
    want = []
    for i, t, _ in docs:
        lines = None if t is None else [x for p, x in enumerate(t.split("\n")) if not (len(x.strip(" ")) >= 20 and len(sites[x.strip(" ")]) >= 10 and (i is None, i or 0, p) != first[x.strip(" ")])]
        if t is None or "\n".join(lines) == t or "".join(lines).strip():
            want.append((i, None if t is None else "\n".join(lines)))
    assert by_id(at[2]) == sorted(want, key=repr) and sum(note in (t or "") for _, t in want) == 1
    # near copies: one of each group, by five-word shingles
    sets = {}
    for n, (i, t) in enumerate(by_id(at[2])):
        w = (t or "").encode().lower().split()
        sets[n] = (i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), t)
    group = {n: n for n in sets}

    def find(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x[0] is not None and y[0] is not None and x[1] and y[1] and 100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1]):
                group[find(a)] = find(b)
    members = {}
    for n in sets:
        members.setdefault(find(n), []).append(n)
    stay = []
    for m in members.values():
        stay.append(min(((sets[n][0], sets[n][2]) for n in m), key=lambda x: (x[0] is None, x[0] or 0)) if len(m) > 1 else (sets[m[0]][0], sets[m[0]][2]))
    assert [i for i, _ in by_id(at[3])] == [i for i, _ in sorted(stay, key=repr)] and len(stay) < len(sets) - 20
    # benchmark passages
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [decontaminate.words_of(t.encode())] for k in range(len(w) - 9)}
    clean = dict(by_id(at[4]))
    for i, t in by_id(at[3]):
        w = decontaminate.words_of((t or "").encode())
        hit = {k for p in range(len(w) - 9) if tuple(w[p : p + 10]) in grams for k in range(p, p + 10)}
        if not hit:
            assert clean[i] == t
        elif 2 * len(hit) > len(w):
            assert i not in clean
        else:
            assert decontaminate.words_of(clean[i].encode()) == [x for k, x in enumerate(w) if k not in hit]
    assert 310 not in clean and {300, 301, 302, 303} <= clean.keys()
    # BPE
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    want = sorted(((r.doc_id, tk.encode(r.text or "", add_special_tokens=False).ids) for r in at[4].collect()), key=repr)
    got = sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in at[5].collect()), key=repr)
    assert got == want
    # the whole is the stages one after another
    whole = sorted(((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, root).collect()), key=repr)
    assert whole == sorted(((r.doc_id, bytes(r.ids)) for r in at[5].collect()), key=repr)


def test_pipeline_of_an_empty_table(spark, world, tmp_path):
    root = world[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
