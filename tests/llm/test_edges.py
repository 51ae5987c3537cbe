"""Odd ids and column names in the operators that return whole rows."""

import pytest
from pyspark.sql import functions as F

from catalith.llm import byte_bpe, common, exact_dedup, langid, packing, quality, simhash, suffix_dedup, token_counts, token_files

LOW = -(1 << 63)


@pytest.mark.parametrize("step", [exact_dedup.deduplicated, simhash.deduplicated, suffix_dedup.cut])
def test_any_column_names(spark, step):
    names = "doc_id long, text string, ROW_KEY long, row_key_ string, row long, key int, left string, left_text int, id int, kept int, n int, fp int, `a.b` int"
    rows = [(i, t, 1, "x", 2, 3, "y", 4, 5, 6, 7, 8, 9) for i, t in [(1, "one two three four"), (None, "other words that stand alone"), (2, "one two three four"), (2, "one two three four")]]
    docs = spark.createDataFrame(rows, names)
    got = step(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(r[0], r[1]) for r in (rows if step is suffix_dedup.cut else rows[:2])], key=str)


def test_language_stage_takes_any_column_names(spark):
    docs = spark.createDataFrame([(1, "ab cd", "x", 1), (3, "12", None, 2), (None, None, None, 3)], "doc_id long, text string, lang string, `a.b` int")
    got = langid.identified(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [1]


def test_cut_keeps_null_texts(spark):
    long = "one passage of more than a hundred bytes that stands in two documents, and is taken from the second of them alone"
    docs = spark.createDataFrame([(1, long + " a", 0), (2, "b " + long, 0), (None, None, 0), (3, None, 0)], "doc_id long, text string, n_chars long")
    assert {(r.doc_id, r.text, r.n_chars) for r in suffix_dedup.cut(docs).collect()} == {(1, long + " a", len(long) + 2), (2, "b ", 2), (None, None, 0), (3, None, 0)}


def test_least_id(spark):
    docs = spark.createDataFrame([(LOW, "a b"), (1, "ab"), (LOW + 1, "a b"), (7, "c"), (LOW, "d")], "doc_id long, text string")
    got = {(r.doc_id, r.group_size): (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {(LOW, 3): (LOW, True), (1, 3): (LOW, False), (LOW + 1, 3): (LOW, False), (7, 1): (7, True), (LOW, 1): (LOW, True)}


def test_hosts_with_very_many_failures(spark):
    hosts = spark.createDataFrame([("a", 1 << 40, 1 << 39), ("b", 10, 9), ("c", 1 << 33, 1 << 33)], "host string, n long, failed long")
    got = {r.host: r.host_rate for r in quality.host_verdicts(hosts).collect()}
    assert 0.5 <= got["a"] < got["c"] <= 1


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_host_verdict_reaches_the_rows(spark):
    """A document that passes its own rules goes with a host most of whose documents fail."""
    good = " ".join(f"word{i}" for i in range(20))
    rows = [(i, "short", "bad.org") for i in range(60)] + [(100, good, "bad.org")] + [(200 + i, good, "good.org") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_verdicts(docs).where(F.col("doc_id") >= 100).collect()}
    assert got[100] == (False, False) and all(got[200 + i] == (False, True) for i in range(60))


def test_null_ids_and_repeated_rows(spark):
    """Every row gets its own result; null ids stay null."""
    text = "some words that are long enough to be packed"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(token_counts.tokenizer_coder().encode_pieces([b"some"]))
    assert n == 1
    counts = sorted(((r.doc_id, r.n_tokens > 0) for r in token_counts.token_counts(docs).collect()), key=str)
    assert counts == sorted([(1, True), (1, True), (None, True), (None, False), (2, False)], key=str)
    digests = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in byte_bpe.round_trip_digest(docs).collect()]
    assert len(digests) == 5 and len({d[2] for d in digests if d[1]}) == 1
    pieces = packing.pack(docs).collect()
    assert sorted((p.doc_id for p in pieces), key=str) == sorted([1, 1, None, None, 2], key=str) and len({(p.sequence_id, p.offset) for p in pieces}) == 5
    path = common.fresh_path(spark, "tokens")
    token_files.write_token_files(docs, path)
    files = token_files.file_digest(spark, path).collect()
    assert [r.doc_id for r in sorted(files, key=lambda r: r.start)] == [None, None, 1, 1, 2]
    assert {r.start: r.n_tokens for r in token_files.read_metadata(spark, path).collect()} == {r.start: r.n_tokens for r in files}
    classes = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in classes} == {(1, 1), (None, 1), (None, 2), (2, 2)}
    assert simhash.near_duplicates(docs.where("doc_id is null and text is not null")).first().component_id is None


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("step", [exact_dedup.deduplicated, simhash.deduplicated])
def test_a_column_named_as_the_hidden_one(spark, tmp_path, step, stored):
    docs = spark.createDataFrame([(1, "one two three four", 7), (2, "one two three four", 8), (3, "other words alone", 9)], "doc_id long, text string, _metadata int")
    if stored:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    got = step(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "one two three four", 7), (3, "other words alone", 9)]


HIGH = (1 << 63) - 1


def test_largest_id_is_no_null(spark):
    docs = spark.createDataFrame([(HIGH, "a b"), (None, "ab"), (None, "c"), (HIGH, "d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()), key=str)
    assert got == sorted([(HIGH, HIGH, 2, True), (None, HIGH, 2, False), (None, None, 1, True), (HIGH, HIGH, 1, True)], key=str)
    long = "one passage of more than a hundred bytes that stands in two documents, and is taken from the second of them alone"
    rows = [(None, long + " y"), (HIGH, "x " + long), (HIGH, "x " + long), (None, "short"), (HIGH, long + " y")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    same = [n for i, n, _ in got if i == HIGH]
    assert [i for i, _, _ in got].count(None) == 2 and len(same) == 3
    # of the passages, one of the two texts with the largest id keeps it; the null id, which comes last, loses it
    assert sorted(m for i, n, m in got if i is None) == [0, len(long) + 2]
    assert {i: m for i, n, m in ((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(spark.createDataFrame([(HIGH, long), (None, long)], "doc_id long, text string")).collect())} == {HIGH: 0, None: len(long)}


def test_too_many_labels_are_an_error(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "cd", "y"), (3, "ef", "z")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 labels"):
        langid.fit(docs, "text", "lang", languages=2)
    assert langid.fit(docs, "text", "lang", languages=3).languages == ["x", "y", "z"]


def test_letters_above_the_third_plane():
    rare, plain = "\U00030000\U00030001 \U00030002", "\U00020000\U00020001 \U00020002"
    assert sum(len(g) for g in langid.gram_buckets(rare)) == sum(len(g) for g in langid.gram_buckets(plain)) > 12


def test_one_document_with_many_crowded_spans(spark, monkeypatch):
    """What a task holds is settled inside a document too."""
    monkeypatch.setattr(suffix_dedup, "STRINGS_HELD", 20)
    block = "the same forty bytes that all spans begin with " * 3
    rows = [(i, " ".join(f"{block}{i}{k} and more" for k in range(12))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, suffix_dedup.without_repeats(docs, group_spans=2).collect()))
    assert few == sorted(map(tuple, suffix_dedup.without_repeats(docs).collect())) and sum(r[2] for r in few) > 4000
