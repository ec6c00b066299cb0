import random
from collections import Counter

import corpus_pipeline as cp
from tests.llm.conftest import make
from tests.llm.test_dedup import brute_near, brute_runs
from tests.llm.test_models_and_mixing import SOUNDS, spoken


def test_stages_take_effect_and_keep_the_rest(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for i in range(120):
        lang = sorted(SOUNDS)[i % 3]
        rows.append((i, "\n".join(spoken(lang, r, 12) for _ in range(r.randint(1, 5))), lang, f"s{i % 4}", 0))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(10)]
    rows += [(300, None, None, None, 0), (301, "", "aa", "s1", 0), (302, "123 456", None, "s1", 0)]
    make(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    docs, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == cp.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = [tuple(x) for x in docs.collect()]
    assert {x[0] for x in at["language_id"]} == {x[0] for x in rows if x[0] < 300}
    # The stage removes every repeated run of lines, not chunks alone.
    assert {x[0]: x[1] for x in at["line_dedup"]} == {i: t for i, (t, *_) in brute_runs([x[:2] for x in at["language_id"]]).items()} and len(at["line_dedup"]) == len(at["language_id"])
    assert {x[0] for x in at["near_duplicates"]} == {c for _, c, _, _ in brute_near(at["line_dedup"])}
    words = lambda xs: sum(len((x[1] or "").split()) for x in xs)
    assert abs(words(at["mix_sources"]) - 1.5 * words(at["near_duplicates"])) <= 4
    assert all(x[4] == len(x[1]) for x in at["mix_sources"])
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in last) == Counter(x[0] for x in at["mix_sources"])
    run = cp.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.ids_sha256) for x in run) == Counter((x.doc_id, x.ids_sha256) for x in last)
