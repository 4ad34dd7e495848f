from quarrystone.sources import readers


def text(profiles):
    """An A record and B records of profiles (number, heights)."""
    out = " " * 1024
    for number, heights in profiles:
        body = f"{1:6}{number:6}{len(heights):6}{1:6}".ljust(144) + "".join(f"{h:6}" for h in heights[:146])
        out += body.ljust(1024)
        for a in range(146, len(heights), 170):
            out += "".join(f"{h:6}" for h in heights[a : a + 170]).ljust(1024)
    return out


def test_profiles_of_any_length(spark):
    lengths = [1, 146, 147, 316, 317, 1201, 3]
    profiles = [(k + 1, [-32767 if j % 50 == 7 else k * 1000 + j for j in range(n)]) for k, n in enumerate(lengths)]
    files = spark.createDataFrame([("a", text(profiles)), ("empty", ""), ("null", None), ("short", " " * 1024), ("cut", text([(1, [5] * 200)])[:3000 - 952 + 12])], "path string, text string")
    got = {}
    for r in readers.usgs_dem(files).collect():
        got.setdefault((r["path"], r["profile"]), {})[r["place"]] = r["v"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items() if k[0] == "a"} == {("a", n): [None if h == -32767 else float(h) for h in heights] for n, heights in profiles}
    assert {k[0] for k in got} == {"a", "cut"}
    cut = got["cut", 1]
    assert len(cut) == 200 and [cut[i] for i in range(148)] == [5.0] * 148 and all(cut[i] is None for i in range(148, 200))
