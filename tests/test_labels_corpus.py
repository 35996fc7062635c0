import pytest

from lexlab.operators import labels as lab
from lexlab.session import scratch_path
from lexlab.sources import corpus as cor


def test_remap_composition_and_inverse():
    m = lab.remap_ids("general", "finance")
    assert m == {0: 1, 1: 2, 2: 0}
    back = lab.remap_ids("finance", "general")
    assert {k: back[v] for k, v in m.items()} == {0: 0, 1: 1, 2: 2}


def test_remap_missing_name_raises():
    with pytest.raises(ValueError):
        lab.label2id("nope")


def test_remap_dataframe_roundtrip(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, label int")
    same = lab.remap_labels(df, "general", "general")
    assert same is df
    there = lab.remap_labels(df, "general", "finance")
    back = lab.remap_labels(there, "finance", "general")
    assert sorted(map(tuple, back.collect())) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(r.label for r in there.collect()) == [0, 1, 2]


def test_decode_unknown_is_null(spark):
    df = spark.createDataFrame([(0,), (2,), (7,)], "label int")
    got = [r[0] for r in df.select(lab.decode_label("label")).collect()]
    assert got == ["negative", "positive", None]


LINES = [b"Sales rose.@positive", b"Mail us at a@b.example now .@neutral",
         b"Caf\xe9 chain closes shops@negative", b" \xa0padded\t@ neutral ", b"no delimiter here",
         b"", b"  ", b"text@mixed", b"@neutral", b"nel\x85inside@negative", b"a\x00b tail@neutral"]
EXPECTED = {
    "Sales rose.@positive": ("Sales rose.", 2, None),
    "Mail us at a@b.example now .@neutral": ("Mail us at a@b.example now .", 1, None),
    "Café chain closes shops@negative": ("Café chain closes shops", 0, None),
    " \xa0padded\t@ neutral ": ("padded", 1, None),
    "no delimiter here": (None, None, "no_delimiter"),
    "text@mixed": ("text", None, "unknown_label"),
    "@neutral": ("", 1, None),
    "nel\x85inside@negative": ("nel\x85inside", 0, None),
    "a\x00b tail@neutral": ("a\x00b tail", 1, None),
    "": (None, None, "no_delimiter"),
    "  ": (None, None, "no_delimiter"),
}


def _write_corpus(spark):
    import os
    from lexlab.session import local_path
    d = local_path(scratch_path(spark, "corpus"))
    os.makedirs(d, exist_ok=True)
    data = b"\n\n" + b"\n".join(LINES) + b"\n\n"
    with open(f"{d}/Sentences_AllAgree.txt", "wb") as fh:
        fh.write(data)
    return d


def test_line_reader_latin1_and_quarantine(spark):
    d = _write_corpus(spark)
    parsed = cor.read_corpus(spark, d, "all").collect()
    got = {r.line: (r.sentence, r.label, r.reason) for r in parsed}
    assert got == EXPECTED            # a NUL stays inside its line, blank lines are quarantined
    assert len(parsed) == len(EXPECTED) + 3   # two blank lines before, one more after


def test_remap_unknown_id_raises(spark):
    df = spark.createDataFrame([(0,), (None,)], "label int")
    assert sorted(map(str, (r.label for r in lab.remap_labels(df, "general", "finance").collect()))) == ["1", "None"]
    with pytest.raises(Exception, match="unknown label id 7"):
        lab.remap_labels(spark.createDataFrame([(7,)], "label int"), "general", "finance").collect()


def test_strict_mode_raises(spark):
    df = spark.createDataFrame([("ok@neutral",), ("bad",)], "line string")
    with pytest.raises(Exception):
        cor.parse_lines(df, strict=True).collect()


def test_agreement_validation():
    with pytest.raises(ValueError):
        cor.corpus_path("/x", "90")
    assert cor.corpus_path("/x", "75").endswith("Sentences_75Agree.txt")


def test_agreement_subsets_nested(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    df = cor.with_agreement_level(df)
    sizes = [cor.select_agreement(df, a).count() for a in ("all", "75", "66", "50")]
    assert sizes == sorted(sizes) and sizes[-1] == 2000


def test_whole_file_roundtrip_matches_in_memory(spark):
    from lexlab.sources import fixtures as fx
    L = fx.labelled(spark, "/root/testdata/sf0.001")
    lines = fx.corpus_lines(L)
    path = scratch_path(spark, "corpus-rt")
    cor.write_corpus_lines(lines, path)
    back = cor.good_rows(cor.parse_lines(cor.read_corpus_lines(spark, path)))
    mem = cor.good_rows(cor.parse_lines(lines))
    a = sorted((r.sentence, r.label) for r in back.collect())
    b = sorted((r.sentence, r.label) for r in mem.collect())
    assert a == b
