"""The competition tables derived from a star schema of customers, nations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatsheet.operators import number_within

# Columns used here. Naming them spares the job that would read them from a file.
_COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_linenumber int",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def driver(spark: SparkSession, folder: str) -> DataFrame:
    """A driver per customer: every third one has an age, the youngest a caregiver."""
    return read(spark, folder, "customer").selectExpr(
        "c_custkey as driver_id",
        "split_part(c_name, '#', 1) as first_name",
        "split_part(c_name, '#', 2) as surname",
        """case when c_custkey % 3 = 0 then make_date(cast(2013 - c_custkey % 20 as int),
           cast(1 + c_custkey % 12 as int), cast(1 + c_custkey % 28 as int)) end as date_of_birth""",
        "case when c_custkey % 3 = 0 then cast(10 + c_custkey % 20 as int) end as age",
        """case when c_custkey % 3 = 0 and 10 + c_custkey % 20 between 12 and 16
           then c_custkey + 1 end as caregiver""",
        "c_nationkey as car",
    )


def accented(spark: SparkSession, folder: str) -> DataFrame:
    """Drivers whose names differ from each other by case and accents."""
    return driver(spark, folder).withColumns(
        {
            "first_name": F.expr(
                """case driver_id % 6 when 0 then 'José' when 1 then 'JOSE' when 2 then 'jösé'
                   when 3 then 'Åsa' when 4 then 'asa' else 'Zoë' end"""
            ),
            "surname": F.expr(
                """concat(case driver_id % 5 when 0 then 'Zed' when 1 then 'de Boer'
                   when 2 then 'ÉMILE' when 3 then 'emile' else 'Óscar' end,
                   substr(surname, case when driver_id % 4 = 0 then 5 else 9 end))"""
            ),
        }
    )


def chained(spark: SparkSession, folder: str) -> DataFrame:
    """Drivers with three to a car, in long chains of caregivers that fork and return."""
    return driver(spark, folder).withColumns(
        {
            "caregiver": F.expr(
                """case when driver_id % 128 = 0 then null when driver_id % 11 = 0 then driver_id - 4
                   when driver_id % 5 = 0 then driver_id + 7 else driver_id + 1 end"""
            ),
            "car": F.expr("driver_id div 3"),
        }
    )


def car(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").selectExpr(
        "n_nationkey as car_num",
        "n_name as model",
        """case when n_regionkey in (0, 1) then 'FWD' when n_regionkey in (2, 3) then 'RWD'
           else '4WD' end as drive_class""",
    )


def course(spark: SparkSession, folder: str) -> DataFrame:
    """A course per order priority: its digit is the id."""
    return (
        read(spark, folder, "orders")
        .select("o_orderpriority")
        .distinct()
        .selectExpr(
            "substr(o_orderpriority, 1, 1) as course_id",
            "substr(o_orderpriority, 3) as name",
            "substr(o_orderpriority, 1, 1) || '.gif' as image",
        )
    )


_ATTEMPT = [
    "o_custkey as dr_id",
    "substr(o_orderpriority, 1, 1) as crs_id",
    """case when o_orderkey % 8 <> 0 then cast(rint(o_totalprice * 100) as bigint) % 11000
       / cast(100 as double) + 10 end as seconds""",
    "case when o_orderkey % 10 = 0 then cast(o_orderkey % 7 as int) end as cones",
    "case when o_orderkey % 18 = 0 then 1 else 0 end as wd",
]


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Runs without their number, for results, which do not need it."""
    return read(spark, folder, "orders").selectExpr(*_ATTEMPT)


def numbered_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs, numbered per customer and priority, with the order key kept."""
    return number_within(
        read(spark, folder, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", "run_num"
    ).selectExpr("o_orderkey", "cast(run_num as int) as run_num", *_ATTEMPT)


def run(spark: SparkSession, folder: str) -> DataFrame:
    return numbered_orders(spark, folder).select(
        "dr_id", "crs_id", "run_num", "seconds", "cones", "wd"
    )


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "car": car(spark, folder),
        "driver": driver(spark, folder),
        "course": course(spark, folder),
        "run": run(spark, folder),
    }


def flawed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables with repeated keys, orphans, NULLs and over-long texts, for audits."""
    t = tables(spark, folder)
    changed = {
        "car": {
            "model": "case when car_num % 10 = 0 then concat(model, ' second edition') else model end",
            "drive_class": "case when car_num % 7 <> 0 then drive_class end",
        },
        "driver": {
            "surname": """case when driver_id % 47 = 0 then repeat(surname, 3)
               when driver_id % 59 <> 0 then surname end""",
            "caregiver": "case when driver_id % 41 = 0 then -caregiver else caregiver end",
            "car": "case when driver_id % 40 = 1 then 99 when driver_id % 45 <> 2 then car end",
        },
        "course": {
            "name": "case when course_id <> '3' then name end",
            "image": "case when course_id = '4' then repeat(image, 5) else image end",
        },
        "run": {
            "dr_id": "case when dr_id % 53 = 0 then dr_id + 10000000 else dr_id end",
            "crs_id": "case when dr_id % 50 = 7 then '99' else crs_id end",
            "wd": "case when dr_id % 9 <> 0 or run_num <> 2 then wd end",
        },
    }
    again = {
        "car": "car_num % 6 = 0",
        "driver": "driver_id % 50 = 0",
        "course": "course_id = '5'",
        "run": "run_num = 1 and dr_id % 61 = 0",
    }
    return {
        name: df.unionByName(df.filter(again[name])).selectExpr(
            *[f"{changed[name].get(c, c)} as {c}" for c in df.columns]
        )
        for name, df in t.items()
    }


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """Two edits for every run, some out of range and some for runs that do not exist."""
    number = "concat(10 + o_orderkey % 110, '.', lpad(cast(o_orderkey % 100 as string), 2, '0'))"
    return (
        numbered_orders(spark, folder)
        .selectExpr("*", "explode(array(0, 1)) as pass")
        .selectExpr(
            "o_orderkey * 2 + pass as seq",
            "cast(dr_id as string) as dr_id",
            "crs_id",
            """case when pass = 1 and o_orderkey % 97 = 0 then '999'
               when pass = 1 and o_orderkey % 89 = 0 then 'first'
               when pass = 1 and o_orderkey % 83 = 0 then null
               else cast(run_num as string) end as run_num""",
            f"""case when (o_orderkey + pass) % 4 = 0 then null
                when (o_orderkey + pass) % 4 = 1 then ''
                when o_orderkey % 47 = 0 then 'NaN'
                when o_orderkey % 53 = 0 then 'Infinity'
                when o_orderkey % 31 = 0 then '9.99'
                when o_orderkey % 37 = 0 then '120.01'
                when o_orderkey % 41 = 0 then '45.505'
                else {number} end as time""",
            """case when (dr_id + pass) % 3 = 0 then null
               when (dr_id + pass) % 3 = 1 then ''
               else cast(o_orderkey % 27 as string) end as cones""",
            """case when o_orderkey % 5 = 0 then null
               when o_orderkey % 43 = 0 then '2'
               else cast(o_orderkey % 2 as string) end as wd""",
        )
    )


def applicants(spark: SparkSession, folder: str) -> DataFrame:
    """An application per customer, covering every branch of the registration rules."""
    year, month, day = [
        f"cast({n} as string)"
        for n in ("1990 + c_custkey % 36", "1 + c_custkey % 12", "1 + c_custkey % 28")
    ]
    return read(spark, folder, "customer").selectExpr(
        "c_custkey as applicant_id",
        """case when c_custkey % 17 = 0 then ' ' when c_custkey % 37 = 0 then repeat(c_mktsegment, 4)
           else c_mktsegment end as first_name""",
        "case when c_custkey % 11 = 0 then c_name else 'Customer' end as surname",
        """case when c_custkey % 31 = 0 then '999'
           when c_custkey % 19 <> 0 then cast(c_nationkey as string) end as car_num""",
        "case when c_custkey % 4 <> 0 then 'on' end as junior_driver",
        f"""case when c_custkey % 7 = 0 then null
            when c_custkey % 23 = 0 then concat('31-02-', {year})
            when c_custkey % 29 = 0 then ''
            when c_custkey % 3 = 0
              then concat_ws('-', lpad({day}, 2, '0'), lpad({month}, 2, '0'), {year})
            when c_custkey % 3 = 1
              then concat_ws('-', {year}, lpad({month}, 2, '0'), lpad({day}, 2, '0'))
            else concat_ws('-', {day}, {month}, {year}) end as date_of_birth""",
        """case when c_custkey % 5 = 0 then null
           when c_custkey % 13 = 0 then 'nobody'
           when c_custkey % 5 = 1 then '-7'
           else cast(c_custkey + 1 as string) end as caregiver""",
    )


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """Search terms made of market segments and names, good and bad."""
    return read(spark, folder, "customer").selectExpr(
        "c_custkey as term_id",
        """case when c_custkey % 5 = 0 then c_name when c_custkey % 5 = 1 then '  '
           when c_custkey % 5 = 2 then concat(c_mktsegment, ' Customer')
           else c_mktsegment end as search_term""",
    )


def new_drivers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to append to ``driver``, good ones and ones that break every declared constraint."""
    return driver(spark, folder).selectExpr(
        """case when driver_id % 97 = 0 then null
           when driver_id % 10 = 3 then driver_id
           when driver_id % 10 = 4 then 100000000 + driver_id - driver_id % 20
           else 100000000 + driver_id end as driver_id""",
        """case when driver_id % 29 = 0 then null
           when driver_id % 23 = 0 then repeat(first_name, 6) else first_name end as first_name""",
        "case when driver_id % 43 = 0 then null else surname end as surname",
        "date_of_birth",
        "age",
        "case when driver_id % 2 = 0 then -caregiver else caregiver end as caregiver",
        "case when driver_id % 31 = 0 then 99 when driver_id % 37 <> 0 then car end as car",
    )


def name_terms(spark: SparkSession, folder: str) -> DataFrame:
    """A search term for each customer: ends of names, two words, short and blank ones."""
    return read(spark, folder, "customer").selectExpr(
        "c_custkey as term_id",
        """case when c_custkey % 60 = 0 then cast(c_custkey % 7 as string)
           when c_custkey % 60 = 20 then concat(' ', cast(10 + c_custkey % 89 as string))
           when c_custkey % 60 = 40 then ' TOMER '
           when c_custkey % 4 = 0 then concat('  ', substr(c_name, -4), ' ')
           when c_custkey % 4 = 1 then concat(substr(c_name, -5), ' ', substr(c_mktsegment, 1, 4))
           when c_custkey % 4 = 2 then concat('nobody ', substr(c_name, -6))
           when c_custkey % 8 = 3 then '  ' end as search_term""",
    )
