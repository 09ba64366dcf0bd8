from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from strataline.functions import citation
from strataline.operators import refresh
from strataline.plans.options import OptionError, applicable, parse_options


def test_options():
    got = parse_options(["--type", "book", "--limit", "3", "--transcribe", "--work-dir", "/x"])
    assert got == {"type": "book", "limit": 3, "transcribe": True, "work_dir": "/x"}
    for bad in (["--limit", "0"], ["--limit", "x"], ["--type"], ["--type", "--transcribe"], ["--nope"], ["word"]):
        with pytest.raises(OptionError):
            parse_options(bad)
    assert applicable("playlist", got) == {"limit": 3, "transcribe": True}
    for kind in ("youtube", "book"):
        with pytest.raises(OptionError):
            applicable(kind, got)


def test_years(spark):
    assert citation.first_year("on WMT 2014 and 2048 units, in 2017", 2025) == 2017
    assert citation.first_year("only ImageNet 2012", 2025) == 2012 and citation.first_year("none", 2025) is None
    rows = spark.createDataFrame([(1, "at NIPS '17, USA"), (2, "31st Conference on X (Y 2019)"), (3, "arXiv:1706.03762v7  [cs.CL]  2 Aug 2023"), (4, None)], "i int, t string")
    got = {r.i: (r.v, r.s) for r in rows.select("i", citation.venue_year(F.col("t")).alias("v"), citation.stamped_id(F.col("t")).alias("s")).collect()}
    assert got[1][0] == 2017 and got[2][0] == 2019 and got[3][1] == "1706.03762" and got[4] == (None, None)
    assert [r.y for r in rows.select(citation.in_text_year(F.col("t")).alias("y")).collect()] == [None, 2019, 2023, None]


def test_quiz(spark):
    day = datetime.date(2024, 1, 10)
    rows = [("d", 1, "a", day, 2), ("d", 2, "a", datetime.date(2024, 1, 1), 1), ("d", 3, "a", datetime.date(2024, 2, 1), 1), ("d", 4, "a", None, 0), ("d", 5, "a", None, 0), ("d", 6, "b", None, 0)]
    cards = spark.createDataFrame(rows, "deck string, id int, source string, due date, seen int")
    got = refresh.quiz(cards, "deck", F.lit(day), most=4).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1, 4, 6]
