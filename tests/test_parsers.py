"""One valid, one malformed and one edge line per format."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.sources.parsers import parser

T = datetime(2031, 8, 19, 6, 41, 50)
CASES = [
    ("json", '{"time": "2031-08-19T06:41:50Z", "level": "info", "msg": "Kiln door opened", "user": "mira"}', {}, {"timestamp": T, "level": "info", "message": "Kiln door opened", "fields": {"time": "2031-08-19T06:41:50Z", "level": "info", "msg": "Kiln door opened", "user": "mira"}}),
    ("jsonl", '{"message":"m","n":3,"b":true,"z":null,"a":[1],"s":"[1]"}', {}, {"message": "m", "fields": {"message": "m", "n": "3", "b": "true", "s": "[1]"}}),
    ("json", '{"a":', {}, None),
    ("json", "[1]", {}, None),
    ("json", '{"timestamp":"2031-08-19 06:41:50","body":"x","k":"v"}', {"dimensions": ["timestamp", "body", "k"]}, {"timestamp": T, "body": "x", "fields": {"k": "v"}}),
    ("json", '{"body":3}', {"dimensions": ["body"]}, None),
    ("logfmt", 'time=2031-08-19T06:41:50Z level=info msg="Kiln door opened" user=mira', {}, {"timestamp": T, "level": "info", "message": "Kiln door opened"}),
    ("logfmt", "no pairs here", {}, None),
    ("syslog", "Aug 19 06:41:50 kiln2 relay[88]: Kiln door opened", {"year": 2031}, {"timestamp": T, "level": "INFO", "message": "Kiln door opened", "fields": {"host": "kiln2", "program": "relay", "pid": "88"}}),
    ("syslog", "<34>Aug  4 06:41:50 kiln2 su: failed", {"year": 2031}, {"level": "CRIT", "message": "failed", "timestamp": datetime(2031, 8, 4, 6, 41, 50), "fields": {"facility": "auth", "host": "kiln2", "program": "su"}}),
    ("syslog", "Aug  4 06:41:50 oven-2 sshd: y", {"year": 2031}, {"message": "oven-2 sshd: y", "fields": {}}),
    ("syslog", "Aug  4 06:41:50 oven-2 sshd: y", {"year": 2031, "strict": True}, {"message": "y", "fields": {"host": "oven-2", "program": "sshd"}}),
    ("syslog", "", {"year": 2031}, None),
    ("log4j", "2031-08-19 06:41:50,123 INFO [main] org.sample.Oven: Kiln door opened", {}, {"level": "INFO", "message": "Kiln door opened", "timestamp": datetime(2031, 8, 19, 6, 41, 50, 123000), "fields": {"thread": "main", "logger": "org.sample.Oven"}}),
    ("log4j", "not log4j", {}, None),
    ("cef", "CEF:0|acme|oven|2.1|17|door|5|msg=Kiln door opened", {}, {"message": "Kiln door opened", "severity": "5"}),
    ("cef", "CEF:0|too|short", {}, None),
    ("line", "anything", {"now": T}, {"message": "anything", "level": "INFO", "timestamp": T}),
    ("line", "", {}, None),
    ("csv", "2031-08-19T06:41:50Z,ERROR,boom", {"dimensions": ["timestamp", "severity", "body"]}, {"timestamp": T, "severity": "ERROR", "body": "boom"}),
    ("csv", "a,bb,c", {}, {"fields": {"0": "a", "1": "bb", "2": "c"}}),
    ("csv", "a,", {}, {"fields": {"0": "a", "1": ""}}),
    ("csv", 'a,"b,""x""",c', {"quoted": True}, {"fields": {"0": "a", "1": 'b,"x"', "2": "c"}}),
    ("tsv", "a\tb", {}, {"fields": {"0": "a", "1": "b"}}),
    ("regex", "abc 12", {"log_pattern": r"(\w+) (\d+)"}, {"fields": {"1": "abc", "2": "12"}}),
    ("xml", '<e level="WARN"><time>2031-08-19 06:41:50</time><msg>a &lt;b&gt; &amp;amp;</msg><n>3</n></e>', {}, {"timestamp": T, "level": "WARN", "message": "a <b> &amp;", "fields": {"level": "WARN", "time": "2031-08-19 06:41:50", "msg": "a <b> &amp;", "n": "3"}}),
    ("xml", "<e></e>", {}, None),
    ("xml", "<e><a>1</a>", {}, None),
    ("regex", "abc", {"log_pattern": r"(\w+) (\d+)"}, None),
]


@pytest.mark.parametrize("format,line,options,want", CASES)
def test_parser(spark, format, line, options, want):
    got = spark.createDataFrame([(line,)], "v string").select(parser(format)(F.col("v"), **options).alias("r")).first().r
    if want is None:
        assert got is None
    else:
        assert {k: got[k] for k in want} == want


def test_unknown_format():
    with pytest.raises(ValueError):
        parser("xml2")
