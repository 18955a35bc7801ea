"""Default groups of the control corpus."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siftmill.operators.sampling import quotas_of_counts

# Rows per group of the source; quotas follow from them.
GROUP_ROWS = {
    "tifu": 526000, "explainlikeimfive": 1810000, "WritingPrompts": 1000000,
    "changemyview": 257000, "LifeProTips": 715000, "todayilearned": 2150000, "science": 873000,
    "askscience": 1560000, "ifyoulikeblank": 221000, "Foodforthought": 70600,
    "IWantToLearn": 103000, "bestof": 341000, "IAmA": 436000, "socialskills": 260000,
    "relationship_advice": 3280000, "philosophy": 213000, "YouShouldKnow": 94600,
    "history": 284000, "books": 693000, "Showerthoughts": 6360000, "personalfinance": 1350000,
    "buildapc": 3030000, "EatCheapAndHealthy": 79700, "boardgames": 287000,
    "malefashionadvice": 549000, "femalefashionadvice": 131000, "scifi": 135000,
    "Fantasy": 176000, "Games": 831000, "bodyweightfitness": 145000, "SkincareAddiction": 890000,
    "podcasts": 114000, "suggestmeabook": 301000, "AskHistorians": 592000, "gaming": 6420000,
    "DIY": 506000, "mildlyinteresting": 1970000, "sports": 784000, "space": 416000,
    "gadgets": 284000, "Documentaries": 301000, "GetMotivated": 396000, "UpliftingNews": 285000,
    "technology": 2110000, "Fitness": 1040000, "travel": 1010000, "lifehacks": 117000,
    "Damnthatsinteresting": 397000, "gardening": 723000, "programming": 571000,
}


def default_quotas(spark: SparkSession) -> list[tuple[str, int]]:
    """Groups in their order of reading with the chunks wanted from each."""
    counted = spark.createDataFrame(list(GROUP_ROWS.items()), "name string, n long")
    made = {r["name"]: r["quota"] for r in quotas_of_counts(counted, "name").collect()}
    return [(name, made[name]) for name in GROUP_ROWS]
