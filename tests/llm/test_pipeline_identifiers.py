"""Near-duplicate and passage stages over rows whose identifiers are null or repeated."""

import random

from corpus_pipeline import near_duplicate_stage, passage_stage
from tallyspark.llm.common import stored


def test_one_row_of_each_group_keeps_its_text(spark):
    rnd = random.Random(8)
    a, b, c, d, e = (" ".join(f"{name}{rnd.randrange(10**6)}" for _ in range(90)) for name in "abcde")
    assert min(map(len, (a, b, c, d, e))) >= 400
    rows = [
        (7, a), (7, a), (7, a),  # delivered three times
        (None, b), (None, b), (None, b + " end"),  # nobody has an identifier
        (None, c),  # another group without identifiers
        (None, d), (9, d), (3, d),
        (7, e),  # another document under an identifier used above
        (5, ""), (5, None),
    ]
    docs = stored(
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        .repartition(4), "test-docs")
    near = stored(near_duplicate_stage(spark, docs, ""), "test-near")
    got = passage_stage(spark, near, "").collect()
    want = [(3, d), (7, a), (7, e), (None, b), (None, c), (5, ""), (5, "")]
    assert sorted((str(r.doc_id), r.text.removesuffix(" end")) for r in got) == sorted((str(i), t) for i, t in want)
