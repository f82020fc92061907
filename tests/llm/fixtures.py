"""Small tables with what is awkward in them."""

import random

WORDS = ["the", "of", "river", "stone", "Über", "niño", "été", "wall", "green", "seven", "late", "horse", "paper", "cloud", "bread", "iron"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.4) for _ in range(n))


def awkward(spark, schema="doc_id long, text string, score string, spans string, row int, _key int, n long, lang string"):
    """Null and repeated ids, null, empty, wordless, repeated and long texts, and columns with names that operators use."""
    texts = [
        (1, prose(1, 60)), (2, prose(2, 60)), (3, None), (4, ""), (5, "   \n"), (6, "!!! ..."), (None, prose(1, 60)), (None, None),
        (7, prose(7, 4)), (8, prose(8, 1)), (9, prose(9, 9000)), (10, prose(1, 60)), (2, prose(2, 60)), (2, prose(11, 30)), (12, "x" * 5000)]
    width = len(schema.split(","))
    return spark.createDataFrame([(i, t, *["s", "p", 1, 2, 3, "en"][: width - 2]) for i, t in texts], schema)
