"""Small tables with every oddity, for the operators of plumbline.llm."""

import random

from pyspark.sql import functions as F

SYLLABLES = "an be co da er fi go hu in jo ka le mi no op pa qu re so ti ul ve wa xe yo zu".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


#: nulls, empty and blank texts, a repeated row, one id with two texts, a null id, a very long text and odd characters
ODD = [
    (1, prose(1, 80)), (1, prose(1, 80)), (2, None), (3, ""), (4, " \n\t "), (5, prose(5, 60_000)), (None, prose(6, 50)), (None, None), (7, "one"), (7, "two words"),
    (8, "ÉCOLÉ straße 日本語 İstanbul \x00 \x1c½ don't we'll 12 <|endoftext|>x"), (9, "!!! ... ???"), (10, prose(1, 79) + " tail"), (11, "x" * 300_000),
]


def frame(spark, rows=ODD, **more):
    """doc_id and text, and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = {c: F.lit(f"mine {c}") for c in ("text_key", "shard", "slot", "ids", "h", "hits", "fingerprint", "component_id", "n_words", "start", "score", "lang_pred", "label", "kept", "_letter", "value")}
    return df.withColumns(clash | more)


def groups(n: int, pairs) -> list[int]:
    """Smallest member of each one's group."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
