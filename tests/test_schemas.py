
import pytest

from tranche import schemas


@pytest.mark.parametrize("name", list(schemas.DDL))
def test_declared_schema(small_tables, name):
    assert schemas.check(getattr(small_tables, name), name) == []
