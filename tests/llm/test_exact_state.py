"""Files that reach a table of known state with an old modification time."""

import os
import time

from tallyspark.llm.exact_dedup import exact_duplicates
from tests.llm.test_dedup import saved


def test_files_older_than_those_seen_are_read(spark, tmp_path):
    path, state = tmp_path / "t", str(tmp_path / "state")
    groups = lambda: sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_duplicates(spark, str(path), state_path=state).collect())
    saved(spark, [(1, "a"), (2, "b")], path)
    assert groups() == [(1, 1, 1), (2, 2, 1)]
    seen = set(os.listdir(path))
    saved(spark, [(3, "a"), (4, "c")], path)
    for name in set(os.listdir(path)) - seen:
        os.utime(path / name, (time.time() - 400 * 86400,) * 2)
    assert groups() == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]
