import contextlib
import io

from pyspark.sql import functions as F

from tagweave.operators import phrases
from tagweave.plans import tagging


def test_counts_of_places_need_no_join(spark, sf):
    """Nothing is joined back to the tokens, so no side can be broadcast."""
    found, out = tagging.gaz_lower(spark, sf), io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain()
    assert "Join" not in out.getvalue()
    flags = phrases.phrase_flags(tagging._tok(spark, sf), tagging._lexicon(spark, sf), "PLACE", lower=True).where("PLACE")
    want = flags.groupBy("doc_id").agg(F.count("`B-PLACE`").alias("n_places"), F.count("*").alias("n_tokens"))
    assert found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
