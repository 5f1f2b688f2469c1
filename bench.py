"""Time the headline queries and print one JSON line.

Each query is written to the ``noop`` sink, so every row and column is
computed. ``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the cores. Each
query runs once on the smallest tables beside them first, so that start-up and
code generation are not counted; ``BENCH_WARM=0`` skips that.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import queries as checks  # noqa: E402
from cuematch.session import local_session  # noqa: E402

HEADLINES = [
    "knn_hybrid", "knn_cells", "candidate_union", "episode_ranking", "rank_preview", "score_breakdown",
    "match_top1", "episode_summary", "style_redundancy", "report_full",
    "tag_select", "track_targets", "must_not_tags", "track_prompts", "nearest_tags",
    "mean_pool", "hybrid_vector", "embed_texts", "scene_split", "whitespace",
    "signal_stats", "segment_ranges", "audio_hints",
    "validation_report", "track_search", "upsert_tracks", "cascade_delete", "query_validation",
]


# These read the scores or matches that an earlier query of the same run has written;
# the first of each pays for them.
STORED = {
    "rank_preview": "scores", "episode_ranking": "scores and matches", "match_top1": "matches", "episode_summary": "matches",
    "style_redundancy": "matches", "report_full": "matches",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("cuematch-bench", cpus)
    made = checks.queries()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = os.environ.get("BENCH_WARM", "1") != "0" and os.path.isdir(small)
    seconds = {}
    for name in HEADLINES if warm else []:
        made[name](spark, small).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        start = time.perf_counter()
        made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries" + (", warm" if warm else ""),
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "from_stored_tables": {k: round(v, 3) for k, v in seconds.items() if k in STORED},
        "from_inputs": round(sum(v for k, v in seconds.items() if k not in STORED), 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
