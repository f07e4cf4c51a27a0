"""Code tables in both directions, currency, rules over translated codes, the user's own columns."""

from obol import config as C
from obol.operators import scoring
from obol.plans import upload

ROWS = [(1, "HS/Voc", "Owned", "Tech", "Personal", 1550.0, "a"), (2, " Master ", "自有", "Other", "3C/Appliance", 3100.0, "b"),
        (3, None, "Igloo", "", "Yacht", None, None)]
SCHEMA = "k long, education string, residence_status string, main_business string, product string, month_salary double, name string"


def test_codes_there_and_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    to = {r.k: r for r in upload.incoming(df, "en").collect()}
    assert (to[1].education, to[1].residence_status, to[1].main_business, to[1].product) == ("高中/職", "自有", "科技業", "個人用品")
    assert (to[2].education, to[2].residence_status, to[2].main_business) == ("碩士", "自有", "其他")
    assert (to[3].education, to[3].residence_status, to[3].main_business, to[3].product) == (None, "Igloo", "", "Yacht")
    assert (to[1].month_salary, to[2].month_salary, to[3].month_salary) == (50000, 100000, None) and to[1].name == "a"
    assert upload.incoming(df, "zh").first().month_salary == 1550.0
    back = {r.k: r for r in upload.outgoing(upload.incoming(df, "en"), "en").collect()}
    assert (back[2].education, back[2].residence_status, back[3].product) == ("Master", "Owned", "Yacht")


def test_tables_are_one_to_one_and_cover_the_lists():
    assert len(set(C.CODES.values())) == len(C.CODES)
    known = set(C.CODES.values())
    assert all(set(codes) <= known for codes in C.ALLOWED_CODES.values())
    assert set(C.GRADE_CODES) == set(C.GRADES)
    actions = [C.ACT_NORMAL, C.ACT_WATCH, C.ACT_EARLY, C.ACT_ENHANCED, C.ACT_DETERIORATION, C.ACT_INTERVENE, C.ACT_FORCED, C.ACT_ENHANCED_EARLY,
               C.ACT_ENHANCED_PREP, C.ACT_COLLECT_NOW, C.ACT_INTERVENE_PREP]
    assert set(C.ACTION_CODES) == set(actions)


def test_table_as_a_frame_missing_columns_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    t = spark.createDataFrame([("Tech", "T"), ("Other", "O")], "code string, label string")
    got = {r.k: r.main_business for r in scoring.translate_columns(df, {"main_business": t, "absent": t}).collect()}
    assert got == {1: "T", 2: "O", 3: ""}
    assert scoring.translate_columns(df, {"absent": t}).columns == df.columns
    assert [r.main_business for r in scoring.translate_columns(df, {"main_business": t.limit(0)}).orderBy("k").collect()] == ["Tech", "Other", ""]
    assert scoring.translate_columns(df.limit(0), upload.CATEGORY_TABLES).count() == 0


def test_rules_over_translated_codes(spark):
    rows = [(1, "高中", "自有", "學生", "其他", 1.0, 1.0, 12, 3), (2, "HS", "自有", None, "其他", -1.0, 0.0, 0, 3)]
    df = spark.createDataFrame(rows, "k long, education string, residence_status string, main_business string, product string, month_salary double, "
                                     "job_tenure double, loan_term long, paid_installments long")
    got = {r.k: r.violations for r in upload.checked(df).collect()}
    assert got[1] == []
    assert got[2] == ["month_salary_negative", "loan_term_below_1", "paid_above_term", "education_unknown_code", "main_business_unknown_code"]
