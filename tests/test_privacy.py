import pytest

from basketlens import Params
from basketlens.functions.names import normalise_text
from basketlens.operators import privacy
from basketlens.schema import PII_COLUMNS
from basketlens.sources.readers import name_list, read_name_list


def test_normalise_text():
    assert normalise_text("Győző") == "gyozo"
    assert normalise_text("Straße") == "strae"
    assert normalise_text("Łukasz") == "ukasz"
    assert normalise_text(" ANNA ") == "anna"


@pytest.fixture()
def lists(spark):
    male = spark.createDataFrame([(v,) for v in ["Győző", "Péter", "Kim", ""]], "value string")
    female = spark.createDataFrame([(v,) for v in ["anna", " Ágnes ", "Kim"]], "value string")
    return name_list(male), name_list(female)


def test_gender_rule_table(spark, lists):
    rows = [("Győző", "Nagy", "Férfi"), (" ANNA ", "Péter", "Nő"), ("Xqz", "Péter", "Férfi"),
            ("Xqz", "Kovácsné", "Nő"), (None, "Xqz", "Ismeretlen"), (None, None, "Ismeretlen"),
            ("Kim", None, "Férfi"), ("Agnes", None, "Nő"), ("", "", "Ismeretlen")]
    df = spark.createDataFrame([(i, f, l) for i, (f, l, _) in enumerate(rows)], "id int, first_name string, last_name string")
    male, female = lists
    got = {r["id"]: r["gender"] for r in privacy.infer_gender(df, privacy.name_flags(male, female)).collect()}
    assert [got[i] for i in range(len(rows))] == [g for _, _, g in rows]


def test_absent_name_columns_are_null(spark, lists):
    df = spark.createDataFrame([(1, "Kovácsné")], "id int, last_name string")
    male, female = lists
    assert privacy.infer_gender(df, privacy.name_flags(male, female)).first()["gender"] == "Nő"


def test_anonymise_drops_pii_masks_email_keeps_rows(spark, lists):
    cols = ["order_number", "email", "first_name", "last_name", "phone_billing", "postcode_shipping"]
    df = spark.createDataFrame([("1", "a@b.hu", "Győző", "Nagy", "+36", "1111"),
                                ("2", None, None, None, None, None)], ", ".join(f"{c} string" for c in cols))
    male, female = lists
    out = privacy.anonymise(df, male, female, Params())
    assert not set(out.columns) & set(PII_COLUMNS)
    got = {r["order_number"]: r for r in out.collect()}
    assert got["1"]["email"] == "5e1e7445a5@masked.com" and got["1"]["gender"] == "Férfi"
    assert got["2"]["email"] is None and got["2"]["gender"] == "Ismeretlen"


def test_no_email_column_is_skipped(spark, lists):
    df = spark.createDataFrame([("1", "Anna")], "order_number string, first_name string")
    male, female = lists
    assert privacy.anonymise(df, male, female).columns == ["order_number", "gender"]


def test_read_name_list_file(spark, tmpdir_run):
    path = f"{tmpdir_run}/names.txt"
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("Győző\n\n PÉTER \nPéter\n")
    assert sorted(r["name"] for r in read_name_list(spark, path).collect()) == ["gyozo", "peter"]


def test_udf_equals_python_on_every_char(spark):
    from basketlens.functions.names import normalise_name
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    words = [f"{c}Ab{c}x{c}" for c in chars] + [f"  {c}Éva " for c in chars[::7]] + ["Győző", "ﬁona", "Ǆ", "¼x"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r["i"]: r["n"] for r in df.select("i", normalise_name("w").alias("n")).collect()}
    assert [got[i] for i in range(len(words))] == [normalise_text(w) for w in words]


def test_strip_ws_matches_python_strip(spark):
    from basketlens.functions.columns import strip_ws
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    words = [f"{c}{c}A {c} b{c}" for c in chars]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r["i"]: r["s"] for r in df.select("i", strip_ws("w").alias("s")).collect()}
    assert [got[i] for i in range(len(words))] == [w.strip() for w in words]
