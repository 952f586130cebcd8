from __future__ import annotations

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_the_other_queries_stay_where_a_package_of_the_training_data_is_missing():
    code = (
        "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; "
        "from tablerelay.queries import all_queries, all_sql; "
        "assert set(e.queries()) == set(all_queries()) and set(e.oracle_sql()) == set(all_sql())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
