import pytest

import logsift as ls
from logsift.plans.formats import widen


def lines(spark, *values):
    rows = [(i + 1, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "line_no BIGINT, value STRING")


def rows(df):
    return [r.asDict() for r in df.orderBy("line_no").collect()]


def access(request='GET /a?b HTTP/1.1', status="200", size="5", referer="-", agent="-"):
    return f'h - - [29/Feb/2024:23:05:09 -0230] "{request}" {status} {size} "{referer}" "{agent}"'


def test_access_fields(spark):
    got = rows(ls.parse_access(lines(spark, access(size="-", agent=r"a \"b\" c"), "broken line", "")))
    first = got[0]
    assert first["remote_host"] == "h" and first["bytes_sent"] is None and first["referer"] is None
    assert [first[c] for c in ("year", "month", "day", "hour", "minute", "second")] == [2024, 2, 29, 23, 5, 9]
    assert str(first["request_time"]) == "2024-03-01 01:35:09"
    assert first["user_agent"] == 'a "b" c' and first["_corrupt"] is None
    assert [r["_corrupt"] for r in got[1:]] == ["broken line", ""]
    assert got[1]["remote_host"] is None


def test_access_escapes(spark):
    got = rows(ls.parse_access(lines(spark, access(agent=r"\x41\xe9\\x\t\q\x4", referer=r"\"-\""))))
    assert got[0]["user_agent"] == "A\u00e9\\x\tqx4" and got[0]["referer"] == '"-"'


def test_access_modes(spark):
    source = lines(spark, access(), "broken")
    assert ls.parse_access(source, "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="malformed log line: broken"):
        ls.parse_access(source, "FAILFAST").collect()
    with pytest.raises(ValueError):
        ls.parse_access(source, "OTHER")


def test_long_quoted_parts_need_no_stack(spark):
    long = "x" * 200_000 + r"\"" * 20_000
    got = rows(ls.parse_access(lines(spark, access(agent=long), access(agent=long)[:-1])))
    assert len(got[0]["user_agent"]) == 220_000 and got[1]["_corrupt"] is not None


def test_status_classes(spark):
    codes = ["100", "204", "304", "404", "599", "600", "099"]
    got = rows(ls.parse_access(lines(spark, *[access(status=c) for c in codes])))
    assert [r["status"] for r in got] == [0.1, 0.2, 0.3, 0.4, 0.5, 0.0, 0.0]


def test_requests(spark):
    source = lines(
        spark,
        access("GET /a/?x=1?y=2 HTTP/1.1"),
        access("OPTIONS * HTTP/1.0"),
        access("-"),
        access("GET / HTTP/1.1"),
        access("GET"),
        access("OPTIONS *"),
        "broken",
    )
    got = rows(ls.split_request(ls.parse_access(source)))
    parts = [[r[c] for c in ("command", "url", "parameters", "version")] for r in got]
    assert parts[0] == ["GET", "/a/", "x=1?y=2", "HTTP/1.1"]
    assert parts[1] == ["OPTIONS", "None", "None", "HTTP/1.0"]
    assert parts[2] == ["None"] * 4
    assert parts[3] == ["GET", "/", "None", "HTTP/1.1"]
    assert parts[4] == parts[5] == parts[6] == [None] * 4
    assert [r["_corrupt"] for r in got[4:]] == ["GET", "OPTIONS *", "broken"]


def test_url_and_agent_parts(spark):
    source = lines(
        spark,
        access("GET //a//b/ HTTP/1.1", agent="Mozilla (X11; Linux) y"),
        access("GET /1/2/3/4/5/6/7/8/9/10/ HTTP/1.1", agent=";;".join("abcdefgh")),
    )
    got = rows(ls.split_user_agent(ls.split_url(ls.split_request(ls.parse_access(source)))))
    assert got[0]["url_split"] == ["a", "", "b"]
    assert got[1]["url_split"] == ["1", "2", "3", "4", "5", "6", "7", "8", "9/10"]
    assert got[0]["user_agent_split"] == ["Mozilla ", "X11", " Linux", " y"]
    assert got[1]["user_agent_split"] == ["a", "", "b", "", "c", "", "d", "", "e", "", "f;;g;;h"]


def test_error_log(spark):
    head = "[Mon Jan 01 10:00:00 2024] [core:error] [pid 7] [client 10.0.0.1:99] "
    got = rows(
        ls.parse_error_log(
            lines(spark, head + "bad file  ", head + "bad, referer: http://r ", head + "x, referer: a, referer: b", "[a] [b] c")
        )
    )
    assert got[0]["date_time"] == "Mon Jan 01 10:00:00 2024" and got[0]["source_ip"] == "10.0.0.1"
    assert (got[0]["message"], got[0]["referer"]) == ("bad file", "NONE")
    assert (got[1]["message"], got[1]["referer"]) == ("bad", "http://r")
    assert got[2]["_corrupt"] and got[3]["_corrupt"] == "[a] [b] c"


def test_messages(spark):
    source = lines(spark, "Jan  3 01:02:03 host kernel: a     b c d", "Jan 3 x host sshd[5]: ok", "a b c d")
    got = rows(ls.parse_messages(source))
    assert got[0]["date_time"] == "Jan 3 01:02:03" and got[0]["daemon"] == "kernel:"
    # five spaces: two passes leave two, so one token is empty
    assert got[0]["message"] == ["a", " b c d"]
    assert (got[1]["daemon"], got[1]["message"]) == ("sshd", ["ok"])
    assert got[2]["_corrupt"] == "a b c d"


def test_mail(spark):
    head = "Jan 1 10:00:00 mx sendmail[3]: "
    cases = {
        "abc123456: mail.example.org [10.0.0.1] done": ["abc123456", "mail.example.org", "10.0.0.1", "done"],
        "abc123456: a.b.example.org [10.0.0.1] ok": ["abc123456", "a.b.example.org", "10.0.0.1", "ok"],
        "abc123456: 10.0.0.1 ok": ["abc123456", "No_Hostname", "10.0.0.1", "ok"],
        "a:b: from=u@a.b.c, x": ["No_Message_ID", "No_Hostname", "No_IP_Address", "a:b:", "from=u@a.b.c,", "x"],
        "abc123456: to=<a.b.c> x": ["abc123456", "No_Hostname", "No_IP_Address", "to=<a.b.c>", "x"],
        "abc123456: to=<a.b.c.d> x": ["abc123456", "No_Hostname", "to=<a.b.c.d>", "x"],
        "plain text": ["No_Message_ID", "No_Hostname", "No_IP_Address", "plain", "text"],
        "abc123456: a.+1.c.d x": ["abc123456", "No_Hostname", "a.+1.c.d", "x"],
        "abc123456: a.1_0.c.d x": ["abc123456", "No_Hostname", "a.1_0.c.d", "x"],
        "abc123456: mail.example.org": None,
        "abc123456:": None,
    }
    got = rows(ls.parse_mail(lines(spark, *[head + c for c in cases])))
    assert [r["message"] for r in got] == list(cases.values())
    assert [r["_corrupt"] is not None for r in got] == [v is None for v in cases.values()]


def test_imapd(spark):
    line = 'Jan 1 t h imapd[2]: login: "user" name name os x with'
    assert rows(ls.parse_imapd(lines(spark, line)))[0]["message"] == [
        "login:", "user", "name", "name", "os", "x", "with"]
    assert rows(ls.parse_imapd_filtered(lines(spark, line + " x x")))[0]["message"] == ["user", "x", "x", "x"]


def test_auth_events(spark):
    head = "Jan 1 t h imapd[2]: "
    cases = {
        "login: [1.2.3.4] ann plaintext": (0, 16909060, "ann"),
        "login: host [1.2.3.4] ann x": (0, 16909060, "ann"),
        "login: localhost [::1] ann x": (0, 0, "ann"),
        "badlogin: [0.0.0.9] plaintext bob invalid": (1, 9, "bob"),
        "badlogin: host [0.0.0.9] plaintext bob x": (1, 9, "bob"),
        "badlogin: host [0.0.0.9] plain [x]": (1, 9, "unknown"),
        "TLS negotiation failed: host [0.0.1.0]": (2, 256, "unknown"),
        "login: [1.2.3.400] ann x": "corrupt",
        "login: [1.2.3.4]": "corrupt",
        "login: host": "corrupt",
        "badlogin: [0.0.0.9] plaintext": "corrupt",
        "badlogin: [0.0.0.9]": "corrupt",
        "accepted connection now": "dropped",
    }
    source = lines(spark, *[head + c for c in cases], "too few tokens")
    got = {r["line_no"]: r for r in rows(ls.imapd_auth_events(source))}
    for i, want in enumerate(cases.values(), 1):
        if want == "dropped":
            assert i not in got
        elif want == "corrupt":
            assert got[i]["_corrupt"] and got[i]["what"] is None
        else:
            assert (got[i]["what"], got[i]["IP"], got[i]["userid"]) == want
    assert got[len(cases) + 1]["_corrupt"] == "too few tokens"
    kept = ls.imapd_auth_events(source, mode="DROPMALFORMED")
    counts = ls.imapd_auth_counts(kept).collect()
    assert sum(r.login + r.badlogin + r.failed for r in counts) == 7
    assert [(str(r.IP), r.userid) for r in counts] == sorted((str(r.IP), r.userid) for r in counts)


def test_expand_and_widen(spark):
    table = ls.parse_messages(lines(spark, "a b c d e: 1 2 3", "a b c d e: 1"), mode="DROPMALFORMED")
    wide = widen(table, "messages")
    assert wide.columns[-2:] == ["message_0", "message_1"]
    chosen = ls.select_features(wide, "messages")
    assert chosen.columns == ["line_no", "daemon", "message_0", "message_1"]
    narrow = ls.expand_tokens(table.select("line_no", "message"), "message", "m", 1)
    assert narrow.columns == ["line_no", "m_0"]
    # the last column keeps what does not fit
    words = {r.line_no: " ".join(r.message) for r in table.collect()}
    assert {r.line_no: r.m_0 for r in narrow.collect()} == words


def test_parsers_accept_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(access() + "\nbroken\n")
    stream = spark.readStream.format("text").load(str(tmp_path / "in"))
    query = (
        ls.split_request(ls.parse_access(stream, "DROPMALFORMED"), "DROPMALFORMED")
        .writeStream.format("memory").queryName("parsed").start()
    )
    query.processAllAvailable()
    query.stop()
    assert [r.command for r in spark.table("parsed").collect()] == ["GET"]
