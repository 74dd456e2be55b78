import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ctrkit.session import build_session, shared_root
    s = build_session("local[4]", app_name="ctrkit-tests", shuffle_partitions=4,
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    shared_root(s)
    yield s
    s.stop()
