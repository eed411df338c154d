import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def test_rows_of_a_group_in_any_order(tmp_path):
    path = ":".join([os.path.dirname(os.path.dirname(HERE)), HERE, os.environ.get("PYTHONPATH", "")])
    run = subprocess.run([sys.executable, f"{HERE}/remote_blocks.py", f"file://{tmp_path}"], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=600)
    assert "all the same" in run.stdout, run.stderr[-3000:]
