import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

META = "struct<version:int,timestamp:bigint,changeset:bigint,uid:bigint,user:string>"
TAGS = "array<struct<k:string,v:string>>"
MEMBERS = "array<struct<ref:bigint,type:string,role:string>>"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def meta(version, timestamp=0, changeset=1, uid=1, user="u"):
    return (version, timestamp, changeset, uid, user)
