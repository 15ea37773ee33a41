"""F2 as an Arrow UDF: no regex looks at each character, same strings."""

import re

from quarry.functions import text as T

TEXTS = [None, "", "  the THE, Kelvin \u212a \u0130x  ab abc\tdef a1b2 \u00e9t\u00e9 x", "foo-bar  stop WORDS"]


def plain(text, stop):
    if text is None:
        return None
    words = re.sub("[^A-Za-z0-9 ]+", "", text.lower()).split(" ")
    return " ".join(w for w in words if len(w) > 2 and w not in stop)


def test_preprocess_is_one_pass_of_python(spark, capsys):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.preprocess("t", ["stop", "foobar"]).alias("d"))
    assert {r.t: r.d for r in df.collect()} == {t: plain(t, {"stop", "foobar"}) for t in TEXTS}
    df.explain()
    assert "regexp_replace" not in capsys.readouterr().out
