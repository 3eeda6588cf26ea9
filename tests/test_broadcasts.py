"""What grows with the tables is not sent whole through the driver: Spark's guesses of sizes let it broadcast millions of rows."""

import pytest

import __spark_entry__ as entry
from reelgrid.operators import hls

_DRM = '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://a",KEYFORMAT="com.apple.streamingkeydelivery"\n'
TEXTS = [
    "#EXTM3U", "#EXTM3U\n#EXT-X-ENDLIST", "#EXTM3U\n#EXTINF:4,\na.ts\n#EXTINF:5,\nb.ts\n#EXT-X-ENDLIST", "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\nv.m3u8", "text", None,
    f"#EXTM3U\n{_DRM}#EXTINF:4,\na.ts", '#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="k"\na.ts\n#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k"\nb.ts',
    f'#EXTM3U\n{_DRM}#EXT-X-MAP:URI="i.mp4"\n#EXT-X-KEY:METHOD=AES-128,URI="k"\na.ts', '#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="data:x"\n#EXT-X-MAP:URI="i.mp4"\n#EXT-X-KEY:METHOD=NONE\na.ts',
]


def test_summaries(spark):
    """One reading gives what the join of playlists and their segments gives, and the facts that the playlists were made for."""
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "playlist_id int, text string").selectExpr("playlist_id", "'https://h/i' AS base_url", "text")
    parsed = hls.playlists(texts)
    joined = sorted(map(tuple, hls.summarize_media(parsed, hls.segments(parsed)).collect()))
    assert joined == sorted(map(tuple, hls.read_summaries(texts).collect()))
    assert joined == [(0, 0, 0.0, True, "NONE", False), (1, 0, 0.0, False, "NONE", False), (2, 2, 9.0, False, "NONE", False), (6, 1, 4.0, True, "DRM", True), (7, 2, 0.0, True, "SAMPLE-AES", False), (8, 1, 0.0, True, "DRM", True), (9, 1, 0.0, True, "AES-128", False)]
    assert (found := hls.encryption(hls.segments(parsed)).where("playlist_id = 8").first())["systems"] == ["FairPlay"] and not found["supported"]


@pytest.mark.parametrize("name", ["decrypted_segments", "hls_summary", "odd_manifests"])
def test_no_broadcast(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.count()
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
