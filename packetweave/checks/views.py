"""The packet list seen over the ``events`` table, for Spark and for plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BODY = """
select {captures}event_id + 1 as frame_number, {epoch} as {q}timestamp{q},
  case user_id % 5
    when 0 then concat('192.168.1.', cast(user_id as {text}))
    when 1 then concat('10.0.0.', cast(user_id as {text}))
    when 2 then concat('172.', cast(10 + user_id % 25 as {text}), '.3.4')
    when 3 then concat('8.8.4.', cast(user_id as {text}))
    else null end as src_ip,
  concat(case when k % 3 = 0 then '10.1.2.' when k % 3 = 1 then '93.184.216.'
         else '172.16.0.' end, cast(k as {text})) as dst_ip,
  case when k < 40 then 'TCP' when k < 60 then 'UDP' when k < 68 then 'HTTP'
       when k < 73 then 'DNS' when k < 76 then 'TLSv1.2' when k < 78 then null
       else concat('P', cast(k as {text})) end as protocol,
  cast(floor(value * 5) as bigint) as length,
  case event_type
    when 'error' then concat('Destination unreachable (Timeout) ', cast(k as {text}))
    when 'signup' then concat(cast(1024 + user_id as {text}), ' → 443 [SYN] Seq=0')
    when 'purchase' then concat(cast(1024 + user_id as {text}), ' → 443 [FIN, ACK]')
    when 'view' then 'Standard query response A'
    else concat('reset by peer ', cast(k as {text})) end as info
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from {events}) e
"""

_CAPTURE = "concat('cap', cast(user_id % 3 as {text})) as capture_id, "


def spark_packets(spark: SparkSession, sf_dir: str, captures: bool = False) -> DataFrame:
    """Canonical packets over ``events``; with ``captures``, keyed by capture."""
    body = _BODY.format(
        captures=_CAPTURE.format(text="string") if captures else "",
        epoch="unix_micros(cast(ts as timestamp)) / 1e6",
        q="`", text="string", events="{events}",
    )
    return spark.sql(body, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def duckdb_packets(captures: bool = False) -> str:
    return _BODY.format(
        captures=_CAPTURE.format(text="varchar") if captures else "",
        epoch="epoch_us(ts) / 1e6", q='"', text="varchar", events="events",
    )
