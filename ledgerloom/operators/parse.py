"""Event XML to typed rows: parsing, classification, normalisation and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import delete_permission, event_data_map, event_data_warnings, event_source, missing_fields, null_if_blank, parse_int64, parse_pid

MAX_CHARACTERS = 4 * 1024 * 1024
SCHEMA = (
    "System struct<Provider: struct<_Name: string>, EventID: string, EventRecordID: string, Channel: string, Computer: string, "
    "TimeCreated: struct<_SystemTime: string>>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>, _corrupt_record string"
)


def utc_timestamp(text: Column) -> Column:
    """An instant written with or without zone (then UTC) as a UTC timestamp without zone; null if it is none."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.timestamp_add("MICROSECOND", F.unix_micros(zoned.try_cast("timestamp")), F.lit("1970-01-01").cast("timestamp_ntz"))


def parse_events(df: DataFrame, column: str = "raw_xml") -> DataFrame:
    """Adds the event's header fields, its data as a map with names in lower case, its source, ``warnings`` and ``parse_error``.

    Errors, the first that holds: too_large, document_type, malformed_xml, missing_system,
    missing_event_id, invalid_event_id, invalid_timestamp, unsupported_event. The time is the data
    field UtcTime, or else the header's. A null text is malformed.
    """
    xml = F.col(column)
    large, doctype = F.length(xml) > MAX_CHARACTERS, xml.contains("<!DOCTYPE")
    usable = F.when(~(large | doctype), xml)
    event = F.from_xml(usable, SCHEMA, {"mode": "PERMISSIVE"})
    pairs = F.transform(F.coalesce(F.col("event.EventData.Data"), F.array()), lambda d: F.struct(d["_Name"].alias("name"), d["_VALUE"].alias("value")))
    # explode_outer of one element: a filter on what is parsed must not be pushed below it, or each text would be parsed for every field anew
    parsed = df.select("*", F.explode_outer(F.array(event)).alias("event"))
    parsed = parsed.select("*", F.explode_outer(F.array(event_data_map(pairs))).alias("data"), event_data_warnings(pairs).alias("warnings")).withColumns(
        {
            "provider": F.col("event.System.Provider._Name"),
            "event_id_text": null_if_blank(F.col("event.System.EventID")),
            "record_id": parse_int64(F.col("event.System.EventRecordID")),
            "channel": null_if_blank(F.col("event.System.Channel")),
            "computer_name": null_if_blank(F.col("event.System.Computer")),
        }
    )
    number = parse_int64(F.col("event_id_text"))
    time = utc_timestamp(F.coalesce(null_if_blank(F.col("data")["utctime"]), null_if_blank(F.col("event.System.TimeCreated._SystemTime"))))
    parsed = parsed.withColumns({"event_id": number.cast("int"), "event_ts": time}).withColumn("source", event_source(F.col("provider"), F.col("event_id")))
    error = (
        F.when(large, "too_large").when(doctype, "document_type").when(xml.isNull() | F.col("event._corrupt_record").isNotNull(), "malformed_xml")
        .when(F.col("event.System").isNull(), "missing_system").when(F.col("event_id_text").isNull(), "missing_event_id")
        .when(F.col("event_id").isNull(), "invalid_event_id").when(F.col("event_ts").isNull(), "invalid_timestamp")
        .when(F.col("source") == "unsupported", "unsupported_event")
    )
    return parsed.withColumns({"parse_error": error, "xml_sha256": F.sha2(xml, 256)}).drop("event", "event_id_text")


def _field(name: str) -> Column:
    return null_if_blank(F.col("data")[name])


def to_delete_events(parsed: DataFrame) -> DataFrame:
    """Deletes (Sysmon 23 and 26); the file is archived only for 23."""
    rows = parsed.where("parse_error IS NULL AND source = 'sysmon_delete'").select(
        F.concat(F.lit("del-"), "xml_sha256").alias("delete_event_id"), F.col("xml_sha256").alias("raw_event_id"), "computer_name", "event_id", "record_id",
        F.col("event_ts").alias("occurred_ts"), _field("targetfilename").alias("full_path"), parse_pid(F.col("data")["processid"]).alias("process_id"),
        _field("image").alias("process_path"), _field("processguid").alias("process_guid"), _field("user").alias("user_name"),
        F.lit(None).cast("string").alias("user_sid"), (F.col("event_id") == 23).alias("archive_expected"),
    )
    fields = {"fullPath": "full_path", "processId": "process_id", "processPath": "process_path", "processGuid": "process_guid", "userName": "user_name"}
    return rows.withColumn("missing", missing_fields({n: F.col(c) for n, c in fields.items()}))


def to_process_contexts(parsed: DataFrame) -> DataFrame:
    """Started processes (Sysmon 1)."""
    return parsed.where("parse_error IS NULL AND source = 'sysmon_process'").select(
        F.col("xml_sha256").alias("raw_event_id"), "computer_name", "record_id", F.col("event_ts").alias("occurred_ts"),
        parse_pid(F.col("data")["processid"]).alias("process_id"), _field("processguid").alias("process_guid"), _field("image").alias("process_path"),
        _field("commandline").alias("command_line"), parse_pid(F.col("data")["parentprocessid"]).alias("parent_process_id"),
        _field("parentimage").alias("parent_process_path"), _field("parentprocessguid").alias("parent_process_guid"), _field("user").alias("user_name"),
        F.lit(None).cast("string").alias("user_sid"),
    )


def to_security_evidence(parsed: DataFrame) -> DataFrame:
    """Object accesses (Security 4663) that held a delete permission; the others give no row."""
    permission = delete_permission(F.col("data")["accesslist"], parse_int64(F.col("data")["accessmask"]))
    return parsed.where("parse_error IS NULL AND source = 'security_4663'").select(
        F.col("xml_sha256").alias("raw_event_id"), "computer_name", "record_id", F.col("event_ts").alias("occurred_ts"),
        _field("objectname").alias("full_path"), parse_pid(F.col("data")["processid"]).alias("process_id"), _field("processname").alias("process_path"),
        _field("subjectusername").alias("user_name"), _field("subjectusersid").alias("user_sid"), permission.alias("delete_permission"),
    ).where("delete_permission <> 'not_observed'")


def import_outcomes(parsed: DataFrame) -> DataFrame:
    """Adds the outcome of a record and its diagnostic: unsupported events and evidence without permission are ignored."""
    permission = delete_permission(F.col("data")["accesslist"], parse_int64(F.col("data")["accessmask"]))
    bare = (F.col("source") == "security_4663") & (permission == "not_observed")
    outcome = F.when(F.col("parse_error") == "unsupported_event", "ignored").when(F.col("parse_error").isNotNull(), "error").when(bare, "ignored").otherwise("succeeded")
    return parsed.withColumns({"outcome": outcome, "diagnostic": F.coalesce("parse_error", F.when(bare, "no_delete_evidence"))})


def mark_unprojectable(rows: DataFrame) -> DataFrame:
    """Turns outcomes into errors where a field that storing needs is missing; a delete's own check comes last and wins."""
    succeeded = F.col("outcome") == "succeeded"
    raw = F.col("record_id").isNull() | F.col("channel").isNull() | F.col("computer_name").isNull()
    process = (F.col("source") == "sysmon_process") & (parse_pid(F.col("data")["processid"]).isNull() | _field("processguid").isNull())
    delete = (F.col("source") == "sysmon_delete") & _field("targetfilename").isNull()
    found = F.when(succeeded & delete, "delete_not_projectable").when(succeeded & process, "process_not_projectable").when(succeeded & raw, "raw_not_projectable")
    return rows.withColumn("unprojectable", found).withColumns(
        {"outcome": F.when(F.col("unprojectable").isNotNull(), "error").otherwise(F.col("outcome")), "diagnostic": F.coalesce("unprojectable", "diagnostic")}
    )


def event_xml(outcome: Column) -> Column:
    """The XML of an audit row (see ``plans.adapter``), for exports and round trips."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    data = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'<Data Name="{name}">'), safe(c.cast("string")), F.lit("</Data>"))).otherwise("")
    security, process = outcome == "security_evidence", outcome == "process_context"
    path = F.col("full_path")
    mask = F.when(F.col("delete_permission") == "delete", "0x10000").when(F.col("delete_permission") == "delete_child", "0x40")
    time = F.date_format("occurred_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(
        F.lit("<Event><System><Provider Name=\""), F.when(security, "Microsoft-Windows-Security-Auditing").otherwise("Microsoft-Windows-Sysmon"),
        F.lit('"/><EventID>'), F.when(security, "4663").when(process, "1").when(outcome == "delete_fact", "23").otherwise("99"),
        F.lit('</EventID><TimeCreated SystemTime="'), F.date_format("occurred_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z"/><EventRecordID>'),
        F.col("record_ordinal").cast("string"), F.lit("</EventRecordID><Channel>"), F.when(security, "s").otherwise("c"), F.lit("</Channel><Computer>"), F.col("computer_name"), F.lit("</Computer></System><EventData>"),
        F.when(security, F.concat(
            data("ObjectName", path), data("ProcessName", F.col("process_path")), data("SubjectUserName", F.col("user_name")), data("SubjectUserSid", F.col("user_sid")),
            data("AccessMask", mask), data("ProcessId", F.concat(F.lit("0x"), F.lower(F.hex("process_id")))),
        )).otherwise(F.concat(
            data("UtcTime", time), data("TargetFilename", path), data("Image", F.col("process_path")), data("User", F.col("user_name")),
            data("ProcessId", F.col("process_id")), data("ProcessGuid", F.col("process_guid")), data("CommandLine", F.col("command_line")),
        )),
        F.lit("</EventData></Event>"),
    )
