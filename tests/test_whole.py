import re

from pyspark.sql import functions as F

from tests.plain_text import sides
from turnloom.functions import text as fn
from turnloom.plans import catalog
from turnloom.plans import text as plans
from turnloom.plans import views as v


def shown(body):
    w = body.split(" ")
    return " / ".join(" ".join(sorted(x)) for x in sides(f"between {' '.join(w[:4])} and {' '.join(w[4:8])}?"))


BODIES = [
    "red boats sail south while green cars park", "the a an of\nsince boats sailed when cars parked north", "boats\nor cars",
    "first line here\nsecond line, boats or cars", "one\r\ntwo three four five six seven", "", "boats or cars or bikes x y z", "\n\n", "ends here\n",
]


def test_sides_of_every_turn(spark, sf):
    rows = spark.createDataFrame(list(enumerate(BODIES)), "arrival long, body string")
    assert {r.arrival: r.sides for r in plans.turn_sides(rows).collect()} == {k: shown(b) for k, b in enumerate(BODIES)}
    want = {r.arrival: shown(r.body) for r in v.turns(spark, sf).collect()}
    got = {r.arrival: r.sides for r in catalog.QUERIES["split_sides_whole"](spark, sf).collect()}
    assert got == want == {r.arrival: r.sides for r in catalog.QUERIES["split_sides"](spark, sf).collect()}


def test_sides_by_since_and_or(spark):
    rows = [("how long since boats sailed when cars parked?",), ("red boats or\nblue cars",)]
    got = [r.s for r in spark.createDataFrame(rows, "q string").select(fn.sides(F.col("q")).alias("s")).collect()]
    assert got == [sides(q) for (q,) in rows] == [[["boats", "sailed"], ["cars", "parked"]], [["red", "boats"], ["blue", "cars"]]]
