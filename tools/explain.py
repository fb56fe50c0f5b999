"""Print the formatted physical plan of registered queries.

usage: SF_DIR=/root/testdata/sf0.1 python tools/explain.py chk_range mon_runs ...
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assay.plans import registry  # noqa: E402
from assay.session import get_session  # noqa: E402


def main(names):
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("local[8]", shuffle_partitions=16)
    registry.load_all()
    for name in names or ["chk_range"]:
        print(f"==== {name}")
        registry.QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
