import datetime as dt

from pyspark.sql import functions as F

from riskfold.functions.dates import MONTHS, normalize_pubdate


def test_every_month_in_every_format(spark):
    rows = []
    for m, name in enumerate(MONTHS, 1):
        day = dt.date(2024, m, 5)
        rows += [(t, day) for t in (f"{name.title()} 5, 2024", f"{name[:3].title()} 05, 2024 at 3:00 PM", f"posted {name[:3].title()}. 5 2024", f"5-{name[:3]}-24",
                                    f"05-{name[:3].upper()}-2024", f"5 {name.title()} 2024", day.strftime("%a, %d %b %Y 10:00:00 +0000"), f"2024-{m}-5",
                                    day.isoformat() + "T10:00:00+00:00", f"2024/{m:02d}/05", f"{m:02d}/05/2024", f"{name.title()} 5th, 2024")]
    rows += [("Sept 5, 2024", dt.date(2024, 9, 5)), ("5-Sep-75", dt.date(1975, 9, 5)), ("5-Sep-73", dt.date(2073, 9, 5)), ("February 30, 2024", None),
             ("Marchy 5, 2024", None), ("date unknown", None), ("", None), ("  ", None), (None, None), ("5-xyz-24", None)]
    out = spark.createDataFrame(rows, "t string, want date").withColumn("got", normalize_pubdate("t")).where(~F.col("got").eqNullSafe(F.col("want")))
    assert out.collect() == []
