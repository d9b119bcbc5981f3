"""Run queries by name (or all) against their oracles: ``python tests/run_oracle.py sf_dir [names]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from carelake.plans.catalog import REGISTRY  # noqa: E402
from carelake.session import get_spark  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = get_spark("oracle", 8)
    con = oracle.connect(sf_dir)
    bad = 0
    for name in names:
        q, start = REGISTRY[name], time.time()
        try:
            if q.oracle is None:
                result, n = None, q.build(spark, sf_dir).count()
            else:
                result, n = oracle.compare(q.build(spark, sf_dir), con, q.oracle), "-"
        except Exception as e:  # noqa: BLE001
            result, n = f"{type(e).__name__}: {str(e)[:1500]}", "-"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.2f}s rows={n} {result or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
