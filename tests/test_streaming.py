"""The stateless line profile gives the same rows as a stream and as a batch."""

import tempfile

from progcorpus.sources import fixtures as fx
from progcorpus.streaming.profiles import line_profile, start_line_profiles

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="pc-stream-src-")
    out = tempfile.mkdtemp(prefix="pc-stream-out-")
    subs = fx.submissions(spark, SF).select("sub_id", "func_code")
    subs.repartition(3).write.mode("overwrite").parquet(src + "/in")
    q = start_line_profiles(spark, src + "/in", subs.schema, out + "/profiles", name="t_profiles")
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(out + "/profiles").collect())
    want = sorted(tuple(r) for r in line_profile(subs).collect())
    assert got == want and len(got) == 1500
