"""Edge cases of the rules on inline rows, and replays of what depends on order."""

import datetime as dt
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant import plans
from foliant.functions import dates, text
from foliant.operators import batching, dedup, identity, lints, structure
from foliant.plans import streams
from foliant.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize("value, want", [("2015-2016", ("2015", "2016")), ("2009-Present", ("2009", "present")), ("2015-06-2016-08", ("2015-06", "2016-08")), ("2015", (None, None)), (" 2001-2003 ", ("2001", "2003")), ("2001-2003, 2005", (None, None)), (None, (None, None))])
def test_ranges_split_whole_values_alone(spark, value, want):
    assert tuple(one(spark, dates.split_range(lit(value).cast("string")))) == want


@pytest.mark.parametrize("year, yy, want", [(1999, 2, 2002), (1999, 0, 2000), (2003, 4, 2004), (2003, 3, None), (1990, 89, None)])
def test_short_ranges_end_in_the_next_such_year(spark, year, yy, want):
    assert one(spark, dates.short_range_end(lit(year), lit(yy))) == want


@pytest.mark.parametrize("t, year, want", [("2020-", 2020, True), ("(2011-", 2011, True), ("2011 - present", 2011, True), ("2021 - 2023 Member", 2021, False), ("Award winner, 2023 - Excellence Award", 2023, False), ("2021 - Member, Board", 2021, True), ("12020-", 2020, False), (None, 2020, False)])
def test_open_years(spark, t, year, want):
    assert one(spark, dates.left_open(lit(t).cast("string"), lit(year))) is want


@pytest.mark.parametrize("dropped, kept, want", [("2001-2003", "2002-2005", True), ("2001-2003", "2004-2005", False), ("2001", "1999-2005", True), ("2001-2003", "2001, 2003", False), ("no date", "2001", True), ("2003", "2001-2003", True), ("2007", "2001", False)])
def test_dropped_dates_must_be_carried(spark, dropped, kept, want):
    assert one(spark, dates.dates_compatible(lit(dropped), lit(kept))) is want


def test_spans_are_completed_from_their_start(spark):
    got = one(spark, dates.written_spans(lit("1998-02, 2001-5, 2003 - present and 2009–2007; 2011")))
    assert [tuple(s) for s in got] == [(1998, 1998), (2001, 2005), (2003, 9999), (2009, 2009), (2011, 2011)]


def test_dates_in_their_section(spark):
    assert [one(spark, dates.section_date(lit(v), lit(f))) for v, f in (("2019-05", "mm/yyyy"), ("2019-05", "mm/yy"), ("2019-05", "yyyy"), ("2019-13", "mm/yyyy"), ("Ongoing", "yyyy"), ("TBD", "yyyy"), ("2019", "mm/yy"))] == ["05/2019", "05/19", "2019", "2019", "Present", "TBD", "2019"]
    assert [one(spark, dates.range_text(lit(a), lit(b), lit(o))) for a, b, o in (("2016", "06/2018", False), ("03/2016", "06/2018", False), ("2016", "2016", False), ("2016", "", True), ("2016", "", False), ("Present", "", True), ("", "2018", False))] == ["2016-2018", "03/2016-06/2018", "2016", "2016-Present", "2016", "Present", "2018"]


def test_names_and_slips(spark):
    assert one(spark, text.vancouver_list(lit("Smith, John A.; Ann Lee Doe and Wren JA"))) == "Smith JA, Doe AL, Wren JA"
    assert [one(spark, text.initials(lit(x))) for x in ("John Albert", "J. A.", "JA", "John A.")] == ["JA"] * 4
    assert [one(spark, text.slip_apart(lit(a), lit(b))) for a, b in (("xander", "xadner"), ("abc", "abd"), ("abc", "abc"), ("abc", "cab"), ("a", "ab"), ("", ""))] == [True, True, False, False, True, False]
    assert one(spark, text.author_pairs(lit("Doe, AB, Lee, C"))) == "Doe AB, Lee C" and one(spark, text.author_pairs(lit("Doe, Ann, Lee"))) == "Doe, Ann, Lee"


def test_folding_and_collapsing(spark):
    assert one(spark, text.accent_fold(lit("Müller Ἀθῆναι Йод が é"))) == "Muller Αθηναι Иод が e"
    assert [one(spark, text.collapse_repeats(lit(x))) for x in ("a | A |  a", "a | b", "a")] == ["a", "a | b", "a"]
    assert one(spark, text.is_subsequence(F.array(lit("a"), lit("c")), F.array(*map(lit, "abc")))) and not one(spark, text.is_subsequence(F.array(lit("c"), lit("a")), F.array(*map(lit, "abc"))))


def test_spans_are_cut_whatever_their_order(spark):
    spans = F.array(*(F.struct(lit(a).alias("start"), lit(b).alias("end")) for a, b in ((6, 8), (0, 3), (2, 4))))
    assert one(spark, text.cut_spans(lit("0123456789"), spans)) == "4589"
    assert [one(spark, text.dea_digit_ok(lit(t))) for t in ("AB1234563", "AB1234564", "A1234563", "")] == [True, False, False, False]


def copies(spark, codes):
    rows = [(i, c, "One and the same text, long enough.") for i, c in enumerate(codes)]
    return [r.kept for r in identity.preferred_copies(spark.createDataFrame(rows, "entry_id long, code string, text string")).orderBy("entry_id").collect()]


def flagged(codes):
    """Pair after pair."""
    seen = set()
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            if not (i in seen and j in seen):
                seen.add(i if codes[i][0] == "T" and codes[j][0] == "M" else j)
    return [i not in seen for i in range(len(codes))]


@pytest.mark.parametrize("codes", [("T1", "M1"), ("M1", "T1"), ("T1", "X1", "M1"), ("T1", "T2", "M1", "M2"), ("T1", "T2"), ("X1", "M1", "T1"), ("T1", "M1", "X1")])
def test_copies_prefer_the_better_code(spark, codes):
    assert copies(spark, codes) == flagged(codes)


def test_short_texts_are_no_copies(spark):
    assert identity.preferred_copies(spark.createDataFrame([(1, "H", "short"), (2, "H", "short"), (3, "H", None)], "entry_id long, code string, text string")).collect() == []


def entry_rows(spark, rows):
    return spark.createDataFrame([(7, "S1", i, t) for i, t in rows], "person long, code string, entry_id long, text string")


def test_different_titles_at_one_place_are_two(spark):
    place = "\tGrand Rounds, Department of Medicine, Example State University, Springfield, 2001"
    rows = [(1, "Early sleep and later memory" + place), (2, "Violin repair without glue" + place), (3, "Early sleep, later memory" + place)]
    got = {(r.a, r.b) for r in identity.near_decisions(entry_rows(spark, rows)).collect()}
    assert got == {(1, 3)}


def test_order_decides_who_drops_whom():
    """The replay of the query that has no SQL, over the pairs of the one that has."""
    pairs = [("p", 1, 2, False), ("p", 1, 3, True), ("p", 2, 3, True), ("p", 4, 5, True), ("p", 5, 6, True)]
    gone = set()
    for _, a, b, drops_b in sorted(pairs):
        if a not in gone and b not in gone:
            gone.add(b if drops_b else a)
    assert gone == {1, 3, 5}


def test_near_drops_and_identity_copies_are_replays(spark):
    pairs = sorted((r.person, r.code, r.a, r.b, r.drops_b) for r in plans.QUERIES["near_dup_entries"](spark, SF).collect())
    gone = set()
    for p, c, a, b, drops_b in pairs:
        if (p, c, a) not in gone and (p, c, b) not in gone:
            gone.add((p, c, b if drops_b else a))
    assert gone and {(r.person, r.code, r.dropped) for r in plans.QUERIES["near_dup_drops"](spark, SF).collect()} == gone
    from foliant.sources.entries import entries

    held, want = {}, set()
    for r in sorted(entries(spark, SF).collect(), key=lambda r: (r.person, r.entry_id)):
        keys = [(0, r.entry_id % 7)] * (r.entry_id % 3 == 0) + [(1, r.entry_id % 5)] * (r.entry_id % 4 == 0) + [(2, f"{r.title}|{r.y}")]
        at = min((held[r.person, k] for k in keys if (r.person, k) in held), default=None)
        if at is None:
            held.update(((r.person, k), r.entry_id) for k in keys if (r.person, k) not in held)
        else:
            want.add((r.person, r.entry_id, at))
    assert want and {tuple(r) for r in plans.QUERIES["identity_key_copies"](spark, SF).collect()} == want


def test_near_pairs_lose_none(spark):
    """Against all pairs, with words that nearly every row has."""
    rng = random.Random(4)
    rows = [(i, f"g{i % 3}", " ".join(["common"] + [rng.choice(["red", "blue", "green", "tree", "house", "road", "river", "stone"]) for _ in range(rng.randint(1, 6))])) for i in range(60)]
    got = {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, g string, t string"), "id", "g", "t").collect()}
    sets = {i: (g, set(t.split())) for i, g, t in rows}
    want = set()
    for a in sets:
        for b in sets:
            (g, x), (h, y) = sets[a], sets[b]
            n = len(x & y)
            if a < b and g == h and (n / len(x | y) >= 0.6 or n / min(len(x), len(y)) >= 0.75):
                want.add((a, b))
    assert got == want and want


def test_open_headings_above(spark):
    rows = [(1, i, level) for i, level in enumerate((1, 2, 3, 2, 3, 1, 3, 2, 6))]
    got = {r.ord: list(r.above) for r in structure.with_ancestors(spark.createDataFrame(rows, "doc long, ord int, level int")).collect()}
    assert got == {0: [], 1: [0], 2: [0, 1], 3: [0], 4: [0, 3], 5: [], 6: [5], 7: [5], 8: [5, 7]}


def test_chains_that_turn_back_lead_nowhere(spark):
    links = {1: None, 2: 1, 3: 2, 4: 3, 5: 6, 6: 5, 7: 8, 8: 9, 9: None, 10: 9, 11: 10, 12: 11, 13: 12}
    got = {r.node: r.root for r in structure.follow(spark.createDataFrame(list(links.items()), "node long, target long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: 9, 8: 9, 10: 9, 11: 9, 12: 9, 13: 9}


def test_subsets_leave_one_of_equal_spans(spark):
    rows = [(1, 1, 0, 10), (1, 2, 0, 10), (1, 3, 2, 5), (1, 4, 8, 12), (1, 5, 12, 12), (2, 6, 3, 3)]
    assert sorted(r.id for r in structure.without_subsets(spark.createDataFrame(rows, "doc long, id long, start int, end int")).collect()) == [1, 4, 6]


def test_ties_move_readable_rows_alone(spark):
    rows = [(1, 1, 3), (1, 2, None), (1, 3, 9), (1, 4, 5)]
    got = {r.i: r.place for r in structure.slots(spark.createDataFrame(rows, "g long, i long, s int"), ["g"], "i", "s").collect()}
    assert got == {1: 4, 2: 2, 3: 1, 4: 3}


def test_packing_is_greedy(spark):
    pack = lambda sizes: one(spark, batching.pack(F.array(*map(lit, sizes)), 10))
    assert pack((4, 6, 1, 20, 3, 3)) == [0, 0, 1, 2, 3, 3] and pack((11,)) == [0] and pack((10, 10)) == [0, 1]


def test_a_failing_check_stops_no_other(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\nA ", None), (2, None, None)], "doc_id long, text string, source string")
    checks = lints.CHECKS | {"broken": lints.Check("WARN", 1.0, lambda t: F.col("no such column")), "wants": lints.Check("WARN", 1.0, lambda t: F.lit(1), ("stage",))}
    got = {(r.lint, r.status): r.docs for r in lints.status(docs, checks).collect()}
    assert got["broken", "failed: AnalysisException"] == 0 and got["wants", "skipped"] == 2 and got["shouting", "ran"] == 1 and got["shouting", "skipped"] == 1
    assert {(r.doc_id, r.lint, r.n) for r in lints.findings(docs).collect()} >= {(1, "repeated_lines", 3), (1, "short_record", 1)}
    assert {r.doc_id for r in lints.findings(docs).collect()} == {1}


def events(spark, tmp_path, rows, parts=3):
    start = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(i, start + dt.timedelta(seconds=s), u) for i, (u, s) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long")
    for k in range(parts):  # several files, so several rows of a key in one batch
        frame.filter(F.col("event_id") % parts == k).write.parquet(f"{tmp_path}/{k}-events.parquet")
    return spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/*events.parquet")


def test_throttles_are_replays(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.randrange(20_000)) for _ in range(200)]
    fixed, sliding = {}, {}
    for u in range(4):
        opened, used, held, counts = None, 0, [], [0, 0, 0, 0]
        for t in sorted(s for v, s in rows if v == u):
            if opened is None or t >= opened + 3600:
                opened, used = t, 0
            used += 1
            counts[0 if used <= 5 else 1] += 1
            held = [x for x in held if x > t - 3600]
            if len(held) < 5:
                held.append(t)
                counts[2] += 1
            else:
                counts[3] += 1
        fixed[u], sliding[u] = tuple(counts[:2]), tuple(counts[2:])
    stream = events(spark, tmp_path, rows)
    total = lambda frame: {r.user_id: (r.a, r.r) for r in streams.drained(spark, frame).groupBy("user_id").agg(F.sum("allowed").alias("a"), F.sum("refused").alias("r")).collect()}
    assert total(streams.throttle.fixed_from_first_hit(stream, 5, 3600)) == fixed
    assert total(streams.throttle.sliding(stream, 5, 3600)) == sliding
    dead = {r.user_id: r.event_id for r in streams.drained(spark, streams.throttle.dead_letters(stream, 12)).collect()}
    assert dead == {u: sorted((s, i) for i, (v, s) in enumerate(rows) if v == u)[12][1] for u in range(4)}


def test_documents_of_all_sorts(spark):
    w = f"xmlns:w='{files.W[1:-1]}'"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("first") + f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc>{p('d')}</w:tc></w:tr></w:tbl>" + f"<w:sdt><w:sdtContent>{p('inside')}</w:sdtContent></w:sdt>" + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{p('page 1')}</w:ftr>")
    made = spark.createDataFrame([("good", bytearray(buffer.getvalue())), ("bad", bytearray(b"no such thing")), ("none", None)], "path string, content binary")
    rows = files.scan_docx(made).collect()
    good = [(r.part, r.kind, r.idx, r.row, r.text) for r in rows if r.path == "good"]
    assert good == [("document", "paragraph", 0, 0, "first"), ("document", "row", 1, 0, "a\nb\tc"), ("document", "row", 1, 1, "\td"), ("document", "paragraph", 2, 0, "inside"), ("document", "paragraph", 3, 0, "x\ty"), ("footer1", "paragraph", 0, 0, "page 1")]
    assert {(r.path, r.kind) for r in rows if r.path != "good"} == {("bad", "unreadable"), ("none", "unreadable")}


def test_a_prefix_of_a_longer_name_is_no_match(spark):
    paths = spark.createDataFrame([("d/web050_stage4.json",), ("d/web05_stage4.json",), ("d/web05-stage4b.json",)], "path string")
    got = files.resolve(paths.withColumn("uid", lit("web05")), F.col("uid"), "stage4").collect()
    assert [(r.uid, r.path) for r in got] == [("web05", "d/web05-stage4b.json")]


def test_blocks_stay_go_come_and_move(spark):
    from foliant.operators import alignment

    rows = lambda *docs: spark.createDataFrame([(d, i, t) for d, texts in docs for i, t in enumerate(texts)], "doc long, idx long, text string")
    before = rows((1, ["a first long line", "b stays", "c goes away", "d stays"]), (2, ["only before"]))
    after = rows((1, ["b stays", "d stays", "a first long lime", "new"]), (3, ["only after"]))
    got = {(r.doc, r.change, r.before_idx, r.after_idx) for r in alignment.aligned(before, after).collect()}
    assert got == {(1, "moved", 0, 2), (1, "equal", 1, 0), (1, "deleted", 2, None), (1, "equal", 3, 1), (1, "added", None, 3), (2, "deleted", 0, None), (3, "added", None, 0)}


def test_kinds_of_lines(spark):
    from foliant.functions import lines

    rows = {"Page 3 of 12": "furniture", "Employer Role Title Start Dates": "columns", "PUBLICATIONS": "caps", "3/2020 Example State Clinical Practice Permit": "content", "Example Regional Hospital": "", "KEY: † indicates a trainee": "furniture", "She has long been working towards better methods": "content prose", "x" * 40 + " | " + "y" * 40: "record"}
    t = F.col("t")
    no = F.lit(False)
    got = spark.createDataFrame([(x,) for x in rows], "t string").select(t, lines.is_furniture(t).alias("furniture"), lines.is_column_header(t).alias("columns"), lines.is_caps_heading(t).alias("caps"), lines.is_content(t, no).alias("content"), lines.is_record(t).alias("record"), lines.is_prose(t).alias("prose")).collect()
    assert {r.t: " ".join(k for k in ("furniture", "columns", "caps", "content", "record", "prose") if r[k]) for r in got} == rows
