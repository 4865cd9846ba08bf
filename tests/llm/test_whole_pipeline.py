"""run() is its stages one after the other, and leaves only their results behind."""

import os
from urllib.parse import urlparse

from lapreplay.llm import common


def tables(spark):
    return sorted(os.listdir(urlparse(common.shared_folder(spark)).path), key=lambda n: os.stat(f"{urlparse(common.shared_folder(spark)).path}/{n}").st_mtime)


def test_run(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    before = set(tables(spark))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    left = [p.rsplit("-", 1)[0] for p in tables(spark) if p not in before]
    stages = [name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES[:-1]]
    assert [p for p in left if p in stages] == stages
    assert not {"measures", "sets", "links", "frequent", "candidates", "windows", "planted"} & set(left)


def test_threads_leave_each_other_alone(spark):
    """What one thread removes after it is done isn't another's; settings are as before."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    meet = Barrier(2, timeout=120)

    def work(k):
        def make():
            first = common.written(spark.range(10 + k), f"first{k}")
            meet.wait()
            second = common.written(first.selectExpr("id + 1 as id"), f"second{k}")
            meet.wait()
            return second

        out = common.written_alone(spark, make, f"out{k}")
        meet.wait()
        return out.count()

    before = {k: spark.conf.get(k) for k in (common.CLEANUP, common.BATCH_ROWS)}
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, range(2))) == [10, 11]
    assert {k: spark.conf.get(k) for k in before} == before
    assert not [t for t in tables(spark) if t.startswith(("first0", "first1", "second"))]
