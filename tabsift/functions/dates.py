"""Date recognition by shape: a text is reduced to a pattern of digit runs, month names, marks and zones, and its numbers are checked as a calendar would.

A shape says where year, month and day stand, but for ``1/2/2024``, whose order is open; so both readings are checked, and a column takes, per
shape, the one that holds more often. No parser is tried and nothing is thrown for texts that are no dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsift.functions.exprs import strip

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = (r"(?<![a-z])(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])")
WEEKDAY = r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +"
#: What a text has to begin like, and its lengths, before anything else is looked at.
BEGINS, SHORTEST, LONGEST = r"^(?:[a-z]{3,9}[,. ]|\d{1,2}[-/. a-z]|\d{4}[-/. ]|\d{8})", 6, 40
#: In order: fractions of seconds, zones, halves of the day, month names, ordinal endings, eight digits, other long runs, years, three digits, days and months.
STEPS = [
    (r"(:\d{1,2})[.,]\d{1,9}", "$1F"), (r"(:\d{1,2}F?) ?(?:z|utc|gmt|[+-]\d{2}(?::?\d{2})?)$", "$1Z"), (r" ?[ap]\.?m\.?(?=Z?$)", "A"), (MONTH_NAME, "M"),
    (r"(?<=\d)(?:st|nd|rd|th)(?![a-z])", ""), (r"(?<!\d)\d{8}(?!\d)", "C"), (r"\d{5,}", "X"), (r"\d{4}", "Y"), (r"\d{3}", "X"), (r"\d{1,2}", "N"),
]
SHAPE = (r"^(?:Y([-/. ])N\1N|N([-/. ])N\2Y|N([-/.])N\3N|N[-/. ]?M[-/. ,]{0,2}Y|M[-. ]{0,2}N[-,]? ?Y|C)(?:(?:t|,? )N:N(?::NF?)?A?Z?)?$")


#: Times of day, of 24 hours and of twice 12, as they have to stand in a text that has one.
CLOCK, HALF_CLOCK = r"(?<!\d)(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d)?(?![\d:])", r"(?<!\d)(?:0?[1-9]|1[0-2]):[0-5]?\d(?::[0-5]?\d)?(?![\d:])"


def _is_date(year: Column, month: Column, day: Column) -> Column:
    return (year != "0000") & F.concat_ws("-", year, month, day).try_cast("date").isNotNull()


def with_date_shape(df: DataFrame, value: Column, where: Column | None = None) -> DataFrame:
    """Adds ``shape`` (null if the text is no date in any reading), ``month_first`` and ``day_first``: whether these readings give a date.

    Where the shape fixes the order both are equal. Only rows that meet ``where`` are looked at.
    """
    text = F.lower(strip(value))
    worth = text.rlike(BEGINS) & F.length(text).between(SHORTEST, LONGEST)
    text = F.when(worth if where is None else where & worth, F.regexp_replace(text, WEEKDAY, ""))
    shape = F.col("date_text")
    for pattern, mark in STEPS:
        shape = F.regexp_replace(shape, pattern, mark)
    df = df.withColumn("date_text", text).withColumn("shape", shape)
    df = df.withColumn("shape", F.when(F.col("shape").rlike(SHAPE), F.col("shape"))).withColumn("date_numbers", F.when(F.col("shape").isNotNull(), F.regexp_extract_all("date_text", F.lit(r"\d+"), F.lit(0))))

    s, one, two, three = F.col("shape"), *(F.try_element_at("date_numbers", F.lit(i)) for i in (1, 2, 3))
    year_first, compact, named = s.startswith("Y"), s.startswith("C"), s.contains("M")
    name = F.floor((F.instr(F.lit(MONTHS), F.substring(F.regexp_extract("date_text", MONTH_NAME, 0), 1, 3)) + 2) / 3).cast("string")
    full = F.when(F.length(three) == 2, F.concat(F.lit("20"), three)).otherwise(three)
    year, month, day = ((F.when(year_first, a).when(compact, F.substring(one, at, size)).when(named, b).otherwise(c)) for a, at, size, b, c in
                        ((one, 1, 4, two, full), (two, 5, 2, name, one), (three, 7, 2, one, two)))
    swapped = F.when(year_first | compact | named, F.col("month_first")).otherwise(_is_date(full, two, one))
    timed = ~s.contains("N:N") | F.when(s.contains("A"), F.col("date_text").rlike(HALF_CLOCK)).otherwise(F.col("date_text").rlike(CLOCK))
    known = s.isNotNull() & timed
    return (df.withColumn("month_first", F.coalesce(known & _is_date(year, month, day), F.lit(False))).withColumn("day_first", F.coalesce(known & swapped, F.lit(False)))
            .withColumn("shape", F.when(F.col("month_first") | F.col("day_first"), F.col("shape"))).drop("date_text", "date_numbers"))
