"""The package sent to workers from a folder where they can't import it."""

import os
import subprocess
import sys
import textwrap

from conftest import ROOT


def test_workers_get_the_package(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession, functions as F
        import wardline
        from wardline.functions import sanitise
        s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        wardline.ship(s)
        print(s.range(1).select(sanitise.sanitised(F.lit('["123-45-6789"]'))["text"]).first()[0])
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=240, capture_output=True, text=True)
    assert done.stdout.strip().splitlines()[-1] == '{"result":["[REDACTED-SSN]"]}'
