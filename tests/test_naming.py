"""Names and fields made of the columns of parts."""

from shelfmark.plans.naming import queries, text_fields
from shelfmark.plans.views import Views
from tests.conftest import SF


def test_fields_of_every_kind_occur(spark, duck):
    """Sheets, logs, sites of several labels, numbers that are none, times out of range and whole blanks, as well as what is plain."""
    rows = [tuple(r) for r in text_fields(Views(spark, SF)).collect()]
    assert {r[6] for r in rows} == {"audio", "cue", "image", "log", "nfo", "other", "playlist"}
    by = lambda column, n: [{r[column] is None for r in rows if r[0] % n == i} for i in range(n)]
    assert by(1, 13) == [{x in (3, 6, 7, 8, 11)} for x in range(13)]
    assert by(2, 13) == [{x not in (2, 4, 9, 12)} for x in range(13)]
    assert by(3, 13) == [{x in (4, 5, 6, 7, 8, 11)} for x in range(13)]
    assert by(7, 8) == [{x not in (2, 3, 5)} for x in range(8)]
    assert [{r[4] for r in rows if r[0] % 13 == i} for i in range(13)] == [{x in (0, 1, 2, 9, 11)} for x in range(13)]
    assert {r[5] for r in rows if r[0] % 6 > 3} == {"a/b"} and 0 in {r[3] for r in rows}
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=key) == sorted(duck.execute(queries()["text_fields"][1]).fetchall(), key=key)
