"""The sources of shared_names are read once, however often the operators look at their rows."""

import datetime as dt
import re

from faultline.plans.queries import container_lines, shared_names
from faultline.sources.otlp import DOUBTFUL


def test_sources_are_read_once(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    kinds = ("error", "view", "click", "signup")
    events = [(i, at + dt.timedelta(seconds=i), i % 7, kinds[i % 4]) for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(
        str(tmp_path / "events.parquet")
    )
    docs = [(i, f"one {i}\ntwo\nthree " + "x" * 150 + "\n", f"src{i % 3}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    names = shared_names(spark, str(tmp_path))
    rows = {r.stream_key: r for r in names.collect()}
    # Three containers, one name: 20 texts of 3 lines.
    assert (rows["docker:app"].origins, rows["docker:app"].lines) == (3, 60)
    # The same files twice.
    assert all(r.origins == 2 for key, r in rows.items() if key.startswith("file:"))
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "events.parquet" not in plan


def test_container_chunks_are_made_once(spark, tmp_path):
    docs = [(i, f"one {i}\ntwo\nthree " + "x" * 150 + "\n", f"src{i % 3}") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    lines = container_lines(spark, str(tmp_path))
    assert lines.count() == 60
    assert "regexp_extract_all" not in lines._jdf.queryExecution().executedPlan().toString()


def test_doubtful_branches_part_at_their_first_character():
    def opened(pattern):
        depth, heads, head = 0, [], ""
        for char in re.sub(r"\\.|\[[^\]]*\]", lambda m: "x" * len(m[0]), pattern):
            depth += (char == "(") - (char == ")")
            if char == "|" and not depth:
                heads.append(head)
                head = ""
            else:
                head += char
        return [*heads, head]

    # One branch for fields, one for what follows an object, one for escapes.
    assert len(opened(DOUBTFUL)) == 3
