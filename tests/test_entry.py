"""The entry works with and without the training-data operators."""

import subprocess
import sys

HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == {name!r} or name == {name!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 45 and set(o) <= set(q) and 'metrics_returns' in q
assert not [n for n in q if n.startswith('op')], q.keys()
"""


def test_without_a_library_or_the_operators():
    for name in ("xxhash", "tallyspark.llm"):
        done = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], capture_output=True, text=True, cwd=sys.path[0] or ".")
        assert done.returncode == 0, done.stderr[-600:]


def test_every_query_has_sql_or_is_of_training_data():
    import __spark_entry__

    missing = __spark_entry__.queries().keys() - __spark_entry__.oracle_sql().keys()
    assert all(n.startswith("op") or n == "pipeline" for n in missing), missing
