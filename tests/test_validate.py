import datetime as dt

import pytest

from lexmill import schemas
from lexmill.operators import validate as v

GOOD = [
    (v.uuid4, ("3f2b8c1e-9d4a-4c6b-8e2f-1a2b3c4d5e6f",)), (v.batch, (["a", "b"],)), (v.number, (500,)), (v.one_of, ("amends", schemas.REFERENCE_TYPE)),
    (v.https_url, ("https://e.org/x", ("e.org",))), (v.folder, ("02-luat/luat-bo-luat",)),
]
BAD = [
    (v.uuid4, ("3f2b8c1e-9d4a-1c6b-8e2f-1a2b3c4d5e6f",)), (v.uuid4, (None,)), (v.batch, ([],)), (v.batch, (["a", "a"],)), (v.batch, ([str(i) for i in range(101)],)), (v.number, (0,)), (v.number, (True,)), (v.day, ("2024-01-01",)),
    (v.one_of, ("x", schemas.NODE_TYPE)), (v.https_url, ("http://e.org",)), (v.https_url, ("https://x.org", ("e.org",))), (v.folder, ("../x",)), (v.folder, ("/a",)),
]


@pytest.mark.parametrize(("check", "args"), GOOD)
def test_good(check, args):
    assert check(*args) == args[0]


@pytest.mark.parametrize(("check", "args"), BAD)
def test_bad(check, args):
    with pytest.raises(ValueError):
        check(*args)


def test_day_and_schema_names():
    assert v.day("1/2/2024") == dt.date(2024, 2, 1)
    assert schemas.RAW_PAGE.names == ["sourceUrl", "scope", "title", "fullText", "attributes", "relations"]
