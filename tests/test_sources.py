import json
import os
import random

import pytest
from pyspark.sql import functions as F

from packetweave import fit
from packetweave.__main__ import main
from packetweave.checks.views import spark_packets
from packetweave.sources import catalog, records, sinks
from packetweave.sources import lines as lines_of
from packetweave.sources.packets import SourceError, check_columns, contract, read_lists, read_packets, require_packets
from packetweave.storage import materialize, scratch_path

HEADER = '"No.","Time","Source","Destination","Protocol","Length","Info"\n'
QUOTED = HEADER + (
    '"1","0.0","10.0.0.1","8.8.8.8","TCP","60","5000 → 80 [SYN] say ""hi"", ok"\n'
    '"2","0.5",,"NA","None","x","back\\\\slash \\"q\\" end"\n'
    '"3","bad","172.20.1.1","172.16.0.1","http","1500","Timeout"\n'
)


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("mode", ["auto", "strict"])
def test_extended_dialect(spark, tmp_path, mode):
    rows = read_packets(spark, write(tmp_path, "a.csv", QUOTED), "extended", mode).orderBy("frame_number").collect()
    assert rows[0]["info"] == '5000 → 80 [SYN] say "hi", ok'
    assert (rows[1]["src_ip"], rows[1]["dst_ip"], rows[1]["protocol"]) == ("unknown",) * 3
    assert rows[1]["length"] == 0.0 and rows[1]["info"] == 'back\\slash "q" end'
    assert rows[2]["timestamp"] is None and rows[2]["length"] == 1500.0
    assert {r["capture_id"].rsplit("/", 1)[1] for r in rows} == {"a.csv"}


def test_basic_dialect_fills_nothing(spark, tmp_path):
    rows = read_packets(spark, write(tmp_path, "a.csv", QUOTED), "basic").orderBy("frame_number").collect()
    assert rows[0]["info"] == '5000 → 80 [SYN] say "hi", ok'
    assert rows[1]["src_ip"] is None and rows[1]["length"] is None
    assert "back\\\\slash" in rows[1]["info"]


def test_escaped_comma_and_plain_escape(spark, tmp_path):
    text = HEADER + '1,0,a,b,TCP,5,x\\, y \\z\n"2","0","a","b","TCP","5","plain"\n'
    rows = read_packets(spark, write(tmp_path, "a.csv", text), "extended").orderBy("frame_number").collect()
    assert [r["info"] for r in rows] == ["x, y z", "plain"]


def test_ragged_rows(spark, tmp_path):
    text = HEADER.replace('"', "") + '"4","1","a"\n"5","2","a","b","c","3","i","extra"\n"6","2","a","b, c","c","3","say ""hi"", ok \n'
    for mode in ("auto", "tolerant"):
        rows = read_packets(spark, write(tmp_path, "r.csv", text), "extended", mode).orderBy("frame_number").collect()
        assert [r["frame_number"] for r in rows] == [4, 5, 6]
        # The tolerant read keeps blanks as empty text.
        assert (rows[0]["src_ip"], rows[0]["dst_ip"], rows[0]["info"]) == ("a", "", "")
        assert rows[1]["info"] == "i"
        assert (rows[2]["dst_ip"], rows[2]["info"]) == ("b, c", "say hi, ok")


def test_encoding_is_chosen_per_file(spark, tmp_path):
    write(tmp_path, "one.csv", HEADER + '"1","0","a","b","TCP","3","café"\n', "latin1")
    write(tmp_path, "two.csv", HEADER + '"1","0","a","b","TCP","3","café"\n"2","0","a","b","TCP","3","naïve"\n')
    rows = read_packets(spark, str(tmp_path), "basic").collect()
    assert sorted((r["capture_id"].rsplit("/", 1)[1], r["info"]) for r in rows) == [("one.csv", "café"), ("two.csv", "café"), ("two.csv", "naïve")]


def test_byte_order_mark(spark, tmp_path):
    rows = read_packets(spark, write(tmp_path, "b.csv", "\ufeff" + QUOTED)).collect()
    assert sorted(r["frame_number"] for r in rows) == [1, 2, 3]


def test_positions_replace_absent_columns(spark, tmp_path):
    lines = "".join(f"s{i},d,TCP,5,x\n" for i in range(500))
    for name in ("one.csv", "two.csv"):
        write(tmp_path, name, "Source,Destination,Protocol,Length,Info\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = read_packets(spark, str(tmp_path), "extended").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("one.csv", "two.csv"):
        part = [r for r in rows if r["capture_id"].endswith(f"/{name}")]
        assert sorted(r["frame_number"] for r in part) == list(range(1, 501))
        assert all(r["src_ip"] == f"s{r['frame_number'] - 1}" and r["timestamp"] == r["frame_number"] - 1 for r in part)


def test_schema_reports():
    full = ["No.", "Time", "Source", "Destination", "Protocol"]
    assert check_columns(full).status == "ok"
    assert check_columns(full[:4]).status == "warn"
    assert check_columns(full[:3]).status == "warn"
    assert check_columns(full[:2]).status == "reject"


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(SourceError):
        read_packets(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(SourceError):
        read_packets(spark, write(tmp_path, "empty.csv", ""))
    with pytest.raises(SourceError):
        read_packets(spark, write(tmp_path, "other.csv", "a,b\n1,2\n"), "basic")
    with pytest.raises(SourceError):
        require_packets(read_packets(spark, write(tmp_path, "head.csv", HEADER)))
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    write(mixed, "a.csv", QUOTED)
    write(mixed, "b.csv", 'Time,"No."\n1,2\n')
    with pytest.raises(SourceError, match="another header"):
        read_packets(spark, str(mixed))


def test_equal_names_in_two_folders_are_two_captures(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, "x.csv", QUOTED)
    rows = read_packets(spark, f"{tmp_path}/*/x.csv").groupBy("capture_id").count().collect()
    assert sorted((r["capture_id"].split("/")[-2], r["count"]) for r in rows) == [("a", 3), ("b", 3)]


def test_overlong_rows_are_refused(spark, tmp_path):
    path = write(tmp_path, "long.csv", HEADER + '"1","0","a","b","TCP","3","i","more"\n"2","0","a","b","TCP","3","i"\n')
    for profile, mode in (("basic", "auto"), ("basic", "strict"), ("extended", "strict")):
        with pytest.raises(SourceError, match="more than 7 fields: 1 in"):
            read_packets(spark, path, profile, mode)
    assert read_packets(spark, path, "extended").count() == 2


def test_only_the_first_line_is_the_header(spark, tmp_path):
    row = '"1","0","a","b","TCP","3","i"\n'
    head = HEADER.replace('"', "")
    path = write(tmp_path, "twice.csv", head + row + head + row + head)
    for mode in ("auto", "strict", "tolerant"):
        rows = read_packets(spark, path, "extended", mode).collect()
        assert sorted(r["info"] for r in rows) == ["Info", "Info", "i", "i"]


def test_contract_takes_the_first_address(spark):
    df = spark.createDataFrame([("1", "0", "a,b", "c", "TCP", "5", "x, y")], "n string, t string, s string, d string, p string, l string, i string")
    names = dict(zip(["No.", "Time", "Source", "Destination", "Protocol", "Length", "Info"], df.columns))
    assert tuple(contract(df, names).first()) == ("1", "0", "a", "c", "TCP", "5", "x, y")


def test_catalogue(spark, tmp_path):
    deep = tmp_path / "sub" / "deeper"
    deep.mkdir(parents=True)
    for path, size in ((tmp_path / "a.pcap", 10), (tmp_path / "sub" / "b.PCAPNG", 5), (tmp_path / "sub" / "c.cap", 200), (deep / "d.pcap", 10), (tmp_path / "e.txt", 9)):
        path.write_bytes(b"x" * size)
    found = catalog.capture_catalog(spark, str(tmp_path), below_bytes=100, max_depth=2)
    assert {r["file_name"] for r in found.collect()} == {"a.pcap"}
    found = catalog.capture_catalog(spark, str(tmp_path), max_depth=None)
    assert {r["file_name"] for r in found.collect()} == {"a.pcap", "c.cap", "d.pcap"}
    (tmp_path / "z.pcapng").write_bytes(b"new")
    assert catalog.latest_capture(spark, str(tmp_path)).first()["file_name"] == "z.pcapng"
    counts = spark.createDataFrame([("a.csv",), ("a.csv",), ("z.csv",)], "capture_id string")
    facts = {r["file_name"]: r["packets"] for r in catalog.capture_facts(found, counts).collect()}
    assert facts["a.pcap"] == 2 and facts["c.cap"] is None
    # With the default reader captures are paths; a list of the same name elsewhere is another one.
    for folder, rows in ((tmp_path, 3), (tmp_path / "sub", 1)):
        write(folder, "a.csv", HEADER + '"1","0","a","b","TCP","3","x"\n' * rows)
    packets = read_packets(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/sub/a.csv"])
    facts = {r["file_name"]: (r["packets"], r["capture_id"]) for r in catalog.capture_facts(found, packets).collect()}
    assert facts["a.pcap"][0] == 3 and facts["a.pcap"][1].endswith("/a.csv") and facts["d.pcap"] == (None, None)


def test_result_documents(spark, small, tmp_path):
    model = fit(spark_packets(spark, small), trainer="lloyd", iterations=2)
    sinks.write_json(model, str(tmp_path / "json"))
    back = sinks.read_results(spark, str(tmp_path / "json"))
    assert back.count() == 1000 and sinks.score_cutoff(back, 0.5).filter("anomaly_score <= 0.5").isEmpty()
    text = spark.read.text(str(tmp_path / "json" / "summary")).first()[0]
    summary = json.loads(text)["summary"]
    assert summary["total_packets"] == 1000 and sum(summary["cluster_sizes"].values()) == 1000
    sinks.write_csv(model, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1000


def test_command_line(spark, small, tmp_path, capsys):
    path = scratch_path(spark, "cli")
    raw = {"frame_number": "No.", "timestamp": "Time", "src_ip": "Source", "dst_ip": "Destination",
           "protocol": "Protocol", "length": "Length", "info": "Info"}
    sinks.write_packets_csv(spark_packets(spark, small).withColumnsRenamed(raw), path)
    out = str(tmp_path / "out")
    assert main(["extended", path, "-c", "4", "--trainer", "lloyd", "-o", out, "--series", str(tmp_path / "series")]) == 0
    assert sinks.read_results(spark, out).count() == 1000
    assert spark.read.parquet(str(tmp_path / "series" / "score_histogram")).count() == 30
    assert main(["basic", "-f", path, "--sample", "300", "--trainer", "lloyd"]) == 0
    shown = capsys.readouterr().out
    assert "Traffic summary" in shown and "Component loadings" in shown
    assert main(["extended", path, "-c", "5000"]) == 1
    # A file with another header is named; the others are analysed.
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    write(foreign, "b.csv", "x,y\n1,2\n")
    assert main(["extended", path, str(foreign), "-c", "4", "--trainer", "lloyd"]) == 0
    assert "another header" in capsys.readouterr().out


def plain_records(text, escapes):
    """Records by one walk over the characters: fields open with a quote at their start only."""
    records, now, state, hidden = [], "", "fresh", False
    for c in text:
        if hidden:
            now, hidden, state = now + c, False, "fresh" if c == "\n" and state != "quoted" else "plain" if state in ("fresh", "after") else state
            continue
        if escapes and c == "\\":
            hidden, now = True, now + c
            continue
        if c == "\n" and state != "quoted":
            records.append(now)
            now, state = "", "fresh"
            continue
        now += c
        if c == '"':
            state = {"fresh": "quoted", "after": "quoted", "quoted": "after", "plain": "plain"}[state]
        elif state != "quoted":
            state = "fresh" if c == "," else "plain"
    return [r for r in [*records, now] if r.strip(" ")], state != "quoted"


@pytest.mark.parametrize("escapes", [False, True])
def test_records_are_cut_as_by_one_walk(spark, tmp_path, escapes):
    """Random quotes, commas, breaks and backslashes over files of many splits."""
    rng = random.Random(3)
    texts = {}
    for i in range(12):
        text = "".join(rng.choice(['"', '"a"', ",", "\n", '"\n', "x", '""', ",", "\\" if escapes else "b", '\\"', '"b\nc",']) for _ in range(300)) + "x"
        texts[os.path.basename(write(tmp_path, f"{i}.txt", text))] = text
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        lines = materialize(lines_of.apart(lines_of.read_lines(spark, str(tmp_path), blanks=True)), "test-lines")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found, files = records.cut(lines, escapes)
    cut, closed = {}, {os.path.basename(r["_file"]): r["closed"] for r in files.collect()}
    for r in sorted(found.collect(), key=lambda r: (r["_split"], r["_id"])):
        cut.setdefault(os.path.basename(r["_file"]), []).append(r["value"])
    for path, text in texts.items():
        wanted, ended = plain_records(text, escapes)
        assert cut[path] == wanted and closed[path] == ended, path


@pytest.mark.parametrize("profile", ["extended", "basic"])
def test_line_breaks_inside_quotes(spark, tmp_path, profile):
    long = "\n".join(f'line {i}, ""q"" ' for i in range(60))
    text = HEADER + f'"1","0","a","b","TCP","3","one\r\ntwo\n\nthree"\r\n"2","1","a","b","UDP","4","{long}"\n\n"3","2","a","b","TCP","5","5"" disk"\n4,3,a,b,TCP,6,5" disk\n"5","4","a\nb","c","TCP","7","last"'
    path = write(tmp_path, "m.csv", text)
    write(tmp_path, "plain.csv", HEADER + '"1","0","a","b","TCP","3","x"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = read_packets(spark, str(tmp_path), profile).filter(F.col("capture_id").endswith("m.csv")).orderBy("frame_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert os.path.getsize(path) > 5 * 200 and [r["frame_number"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["info"] for r in rows] == ["one\r\ntwo\n\nthree", long.replace('""', '"'), '5" disk', '5" disk', "last"]
    assert rows[4]["src_ip"] == "a\nb"
    if profile == "basic":
        with pytest.raises(SourceError, match="a quote that never ends"):
            read_packets(spark, write(tmp_path, "open.csv", HEADER + '"1","0","a","b","TCP","3","x\n'), profile)
    else:
        open_quote = read_packets(spark, write(tmp_path, "open.csv", HEADER + '"1","0","a","b","TCP","3","x\n"2","0","a","b","TCP","3","y"\n'), profile)
        assert [r["frame_number"] for r in open_quote.orderBy("frame_number").collect()] == [1, 2]


def test_escaped_quotes_and_breaks(spark, tmp_path):
    text = HEADER + '"1","0","a","b","TCP","3","say \\"hi\n\\" now"\n"2","0","a","b","TCP","3","end\\\\"\n3,0,a,b,TCP,3,hidden\\\nbreak\n'
    rows = read_packets(spark, write(tmp_path, "e.csv", text)).orderBy("frame_number").collect()
    assert [r["info"] for r in rows] == ['say "hi\n" now', "end\\", "hidden\nbreak"]


def test_single_carriage_returns_end_lines(spark, tmp_path):
    text = HEADER.replace("\n", "\r") + '"1","0","a","b","TCP","3","x\ry"\r"2","0","a","b","TCP","3","z"\r'
    for mode, wanted in (("auto", [(1, "x\ry"), (2, "z")]),):
        rows = read_packets(spark, write(tmp_path, "mac.csv", text), "extended", mode).collect()
        assert sorted((r["frame_number"], r["info"]) for r in rows) == wanted


def test_repeated_headers_keep_their_place(spark, tmp_path):
    head = "Source,Destination,Protocol,Length,Info\n"
    path = write(tmp_path, "twice.csv", head + "a,b,TCP,5,x\n" + head + 'c,d,UDP,6,"y\nz"\n')
    rows = read_packets(spark, path).orderBy("frame_number").collect()
    assert [(r["frame_number"], r["timestamp"], r["src_ip"], r["info"]) for r in rows] == [(1, 0.0, "a", "x"), (2, 1.0, "Source", "Info"), (3, 2.0, "c", "y\nz")]


def test_a_foreign_file_is_listed(spark, tmp_path):
    write(tmp_path, "a.csv", QUOTED)
    write(tmp_path, "b.csv", 'Time,"No."\n1,2\n')
    write(tmp_path, "c.csv", 'x,"y\nz"\n1,2\n')
    lists = read_lists(spark, str(tmp_path))
    assert sorted(r["frame_number"] for r in lists.packets.collect()) == [1, 2, 3]
    assert sorted((r["file"].rsplit("/", 1)[1], r["reason"].split(" ")[0]) for r in lists.refused.collect()) == [("b.csv", "another"), ("c.csv", "another")]


def test_text_with_stand_ins_is_kept(spark, tmp_path):
    odd = "".join(chr(0xE000 + i) + str(i) for i in range(8))
    row = f'"1","0","a","b","TCP","3","{odd}"\n"2","0","a","b","TCP","3","\\"{odd},\n"\n'
    rows = read_packets(spark, write(tmp_path, "p.csv", HEADER + row)).orderBy("frame_number").collect()
    assert [r["info"] for r in rows] == [odd, f'"{odd},\n']
    tolerant = read_packets(spark, write(tmp_path, "p.csv", HEADER.replace('"', "") + f'"1","0","a","b","TCP","3","{odd},"\n'), mode="tolerant").first()
    assert tolerant["info"] == f"{odd},"


def test_a_line_is_parsed_once(spark, tmp_path):
    """Seven typed columns of a line come from one parse."""
    path = write(tmp_path, "a.csv", HEADER + '1,0.5,a,b,TCP,60,"x \\"y\\", \\\\ z"\n2,0.6,,b,UDP,70,one "" two\n')
    read = read_packets(spark, path)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert [r["info"] for r in read.orderBy("frame_number").collect()] == ['x "y", \\ z', 'one "" two']


def test_splits_of_the_multiline_query_stay_few(spark, tmp_path):
    from packetweave.checks import queries

    for size, wanted in ((1000, 1 << 16), (queries.MANY_SPLITS << 17, 1 << 17)):
        (tmp_path / "part").write_bytes(b"x" * size)
        assert queries._split_bytes(spark, str(tmp_path)) == wanted


def test_tolerant_fields_are_found_once(spark):
    frame = spark.createDataFrame([('a," b, ",c ',)], "value string").select(lines_of.tolerant_fields(F.col("value"), 4).alias("fields"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert frame.first()["fields"] == ["a", " b, ", "c", ""]
