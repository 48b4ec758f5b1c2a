import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from touchline.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="touchline-test-ckpt-")})
    yield s
    s.stop()


def ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s)


def mk(spark, rows, schema):
    """createDataFrame that accepts plain numbers for decimal columns."""
    from decimal import Decimal

    from pyspark.sql.types import DecimalType, StructType
    st = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    dec = [isinstance(f.dataType, DecimalType) for f in st.fields]
    fixed = [tuple(Decimal(str(v)) if (is_dec and v is not None and not isinstance(v, Decimal)) else v
                   for v, is_dec in zip(r, dec)) for r in rows]
    return spark.createDataFrame(fixed, st)
