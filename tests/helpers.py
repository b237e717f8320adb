"""Hand-made visit tables."""

import datetime as dt

from pyspark.sql import functions as F

from visitloom.spec import VisitSpec

SPEC = VisitSpec(visit_id="visit_id")
DAY0 = dt.date(2020, 1, 1)
COLUMNS = ("patient_id string, visit_id long, visit_date date, is_future_visit boolean, hba1c double, "
           "bmi double, sex string, diabetes_diagnosis int")


def day(n):
    return DAY0 + dt.timedelta(days=n)


def timeline(spark, rows):
    """Rows ``(patient, day, future, hba1c, diagnosis)``; bmi and sex are filled in."""
    data = [(p, i, day(d), fut, h, 25.0 + i, "F" if i % 2 else "M", dx)
            for i, (p, d, fut, h, dx) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


def history(spark, patient="A", n=4, gap=90, base=5.5, future=()):
    rows = [(patient, i * gap, False, base + 0.05 * i, 0) for i in range(n)]
    return rows + [(patient, d, True, h, dx) for d, h, dx in future]


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def without_future(df):
    return df.filter(~F.col("is_future_visit")).drop("is_future_visit")
