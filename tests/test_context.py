"""Golden rows for the context rules, on Vietnamese text."""

import pytest
from pyspark.sql import functions as F

from medloom import lexicon as lx
from medloom.functions import context as cx
from medloom.functions import text as tx


def one(spark, text, term, column, occurrence=0):
    at = -1
    for _ in range(occurrence + 1):
        at = text.index(term, at + 1)
    df = spark.createDataFrame([(text, at, at + len(term))], "text string, start int, end int")
    return df.select(column(F.col("text"), F.col("start"), F.col("end")).alias("x")).first()["x"]


def flags(spark, text, term, **options):
    return one(
        spark, text, term,
        lambda t, s, e: cx.assertions(t, s, e, cx.section_bounds(t), **options),
    )


@pytest.mark.parametrize(
    "text, term, negated",
    [
        ("Bệnh nhân không sốt", "sốt", True),
        ("Bệnh nhân không sốt nhưng có ho", "ho", False),
        ("Không sốt nhưng có ho", "ho", True),
        ("- Không đau ngực", "đau ngực", True),
        ("Không ho, sốt, đau ngực", "ho", True),
        ("Không ho, sốt, đau ngực", "sốt", True),
        ("Không ho, sốt, đau ngực", "đau ngực", True),
        ("Bệnh nhân không ho; sốt", "sốt", False),
        ("Bệnh nhân không ho. Có sốt", "sốt", False),
        ("KHÔNG SỐT\nho", "ho", False),
        ("Phủ nhận ho, đau đầu", "đau đầu", True),
        ("Hiện không ghi nhận sốt", "sốt", True),
        ("Hiện không có sốt, có ho", "ho", False),
        ("Bệnh nhân chưa ho, tiền căn không sốt kèm nôn, không sụt cân", "sụt cân", True),
    ],
)
def test_negation(spark, text, term, negated):
    assert flags(spark, text, term) == (["isNegated"] if negated else [])


def test_negation_options(spark):
    assert flags(spark, "Không sốt nhưng có ho", "ho", strict_contrast=True) == []
    assert flags(spark, "Không sốt nhưng có ho", "ho", line_rule=False) == []
    assert flags(spark, "Không sốt", "sốt", line_rule=False) == ["isNegated"]


def test_history(spark):
    note = "1. Tiền sử bệnh: hen\n2. Bệnh sử hiện tại: ho\n3. Đánh giá tại bệnh viện: MRI"
    assert flags(spark, note, "hen") == ["isHistorical"]
    assert flags(spark, note, "ho") == []
    assert flags(spark, "1. Tiền sử\nhen\nho", "ho") == ["isHistorical"]
    assert flags(spark, "2. Bệnh sử hiện tại\nho", "ho") == []


def test_section_bounds_count_code_points(spark):
    note = "😀 1. Tiền sử\n2. Bệnh sử hiện tại"
    got = one(spark, note, "Tiền", lambda t, s, e: cx.section_bounds(t))
    assert (got.s1, got.s2, got.s3) == (2, note.index("2."), len(note))


@pytest.mark.parametrize(
    "text, term, expected",
    [
        ("aspirin 325mg x 1", "aspirin", "aspirin 325mg x 1"),
        ("thuốc 10 giọt", "thuốc", "thuốc 10 gi"),
        ("acetaminophen 325-650 mg", "acetaminophen", "acetaminophen"),
        ("metformin - 500 MG po bid, sau ăn", "metformin", "metformin - 500 MG po bid"),
        ("aspirin 81 mg po daily\nlisinopril", "aspirin", "aspirin 81 mg po daily\nlisinopril"),
        ("aspirin mỗi ngày", "aspirin", "aspirin"),
        ("thuốc 1,5 viên  ", "thuốc", "thuốc 1,5 viên"),
    ],
)
def test_drug_expansion(spark, text, term, expected):
    got = one(spark, text, term, lambda t, s, e: tx.slice_text(t, s, cx.expand_drug(t, e)))
    assert got == expected


@pytest.mark.parametrize(
    "text, term, expected",
    [
        ("bị khó thở.", "khó th", "khó thở"),
        ("bị khó thở.", "ó thở", "khó thở"),
        ("(ho)", "ho", "ho"),
        ("a_bcd", "bc", "bcd"),
        ("x yz", "y", "x yz"),
        ("dòng\nmột", "mộ", "một"),
    ],
)
def test_boundary_repair(spark, text, term, expected):
    def cut(t, s, e):
        span = cx.repair_boundaries(t, s, e)
        return tx.slice_text(t, span["start"], span["end"])

    assert one(spark, text, term, cut) == expected


def test_result_capture(spark):
    got = one(spark, "MRI: bình thường\nx", "MRI", lambda t, s, e: cx.result_after(t, e))
    assert got.asDict() == {"text": "bình thường", "start": 5, "end": 16}
    assert one(spark, "MRI :-", "MRI", lambda t, s, e: cx.result_after(t, e)) is None
    got = one(spark, "CT - 5 mm ", "CT", lambda t, s, e: cx.result_after(t, e))
    assert got.asDict() == {"text": "5 mm", "start": 5, "end": 9}


def test_precision_filter(spark):
    rows = [
        ("", None, False),
        ("ct", lx.TEST_NAME, True),
        ("ab", lx.DRUG, False),
        ("ho", None, True),
        ("mủ", None, True),
        ("bình thường", None, False),
        ("cảm thấy mệt", None, True),
        ("cảm thấy", None, False),
        ("500 mg", lx.DRUG, False),
        ("500 mg", lx.TEST_NAME, True),
        ("5,5 VIÊN", lx.DRUG, False),
        ("aspirin 5 mg", lx.DRUG, True),
    ]
    df = spark.createDataFrame(rows, "term string, kind string, keep boolean")
    bad = df.where(cx.passes_precision(F.col("term"), F.col("kind")) != F.col("keep"))
    assert bad.collect() == []


def test_type_correction(spark):
    rows = [
        # term, kind, disease?, drug context?, expected type, still disease?
        ("hoại tử", None, True, False, lx.SYMPTOM, False),
        ("viêm phổi", None, True, False, None, True),
        ("truyền", lx.TEST_NAME, False, True, lx.DRUG, False),
        ("xét nghiệm máu", None, True, False, lx.TEST_NAME, False),
        ("mri", lx.DRUG, False, False, lx.TEST_NAME, False),
    ]
    df = spark.createDataFrame(
        rows, "term string, kind string, d boolean, c boolean, want string, still boolean"
    )
    got = df.withColumn(
        "fix", cx.correct_type(F.col("term"), F.col("kind"), F.col("d"), F.col("c"))
    )
    bad = got.where(
        ~F.col("fix.type").eqNullSafe(F.col("want")) | (F.col("fix.is_disease") != F.col("still"))
    )
    assert bad.collect() == []


@pytest.mark.parametrize(
    "text, term, expected",
    [
        ("truyền 5 mg", "truyền", True),
        ("truyền 5 mgx", "truyền", False),
        ("đang uống truyền", "truyền", True),
        ("truyền dịch", "truyền", False),
        ("truyền đơn vị", "truyền", True),
    ],
)
def test_drug_context(spark, text, term, expected):
    assert one(spark, text, term, cx.has_drug_context) is expected


def test_few_blocks_are_read_around_a_mention(spark):
    lines = ["ab " * n + "mention" + " cd, é😀" * n for n in (1, 20, 60, 300, 2500)]
    text = "\n".join(lines * 2)
    at = [i for i in range(len(text)) if text.startswith("mention", i)]
    df = spark.createDataFrame([(text, i) for i in at], "text string, at int")
    end = F.col("at") + 7
    cut = tx.staged(df, cx.blocks(F.col("text")).alias("cut")).select(
        cx.surroundings(F.col("text"), F.col("at"), end).alias("whole"),
        cx.surroundings_nearby(F.col("text"), F.col("cut"), F.col("at"), end).alias("near"),
        F.array_max(F.transform("cut", F.length)).alias("most"),
    )
    assert all(r.whole == r.near and r.most <= 256 for r in cut.collect())


def test_assertions_do_not_read_the_text_for_each_mention(spark, tmp_path):
    from medloom.catalog import QUERIES

    spark.createDataFrame([(1, "the cough, no fever\nof fever here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "cough fever")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["mention_assertions"](spark, str(tmp_path))
    assert "_blocks" in found._jdf.queryExecution().analyzed().toString()
    assert [r["start"] for r in found.sort("start").collect()] == [4, 14, 23]
