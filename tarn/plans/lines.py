"""Log lines made from the columns of business tables, so that their facts are known from these columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vpc(lineitem: DataFrame) -> DataFrame:
    line = "concat_ws(' ', '2', lpad(cast(l_orderkey as string), 12, '0'), concat('eni-', l_partkey), concat('10.0.', pmod(l_partkey, 256), '.', pmod(l_suppkey, 256)), '192.168.0.1', cast(pmod(l_orderkey * 7, 65536) as string), cast(pmod(l_partkey * 13, 65536) as string), cast(pmod(l_suppkey, 256) as string), cast(cast(l_quantity as int) as string), cast(cast(l_extendedprice as bigint) as string), '1600000000', '1600000060', case l_returnflag when 'A' then 'ACCEPT' when 'R' then 'REJECT' else '-' end, 'OK')"
    return lineitem.select("l_orderkey", "l_linenumber", F.expr(line).alias("message_sanitized"))


def asa(orders: DataFrame) -> DataFrame:
    line = "concat('<166>Jan 02 2024 11:22:33: host %ASA-4-106023: Deny ', case pmod(o_orderkey, 3) when 0 then 'tcp' when 1 then 'udp' else 'icmp' end, ' src ', case pmod(o_custkey, 4) when 0 then 'inside' when 1 then 'outside' when 2 then 'dmz-1' else 'vlan7' end, ':10.1.2.3/', pmod(o_orderkey, 65536), ' dst outside:10.9.8.7/', case when pmod(o_custkey, 5) = 0 then 'USER-0012' else cast(pmod(o_custkey, 70000) as string) end, case when pmod(o_orderkey, 3) = 2 then concat(' (type ', pmod(o_orderkey, 20), ', code ', pmod(o_custkey, 14), ')') else '' end, ' by access-group \"acl_in\" [0x0, 0x0]')"
    return orders.select("o_orderkey", F.expr(line).alias("message_sanitized"))


def cef(events: DataFrame) -> DataFrame:
    line = "concat('CEF:0|Vendor|Product|1.0|100|', event_type, '|5|act=', case pmod(user_id, 4) when 0 then 'Deny' when 1 then 'accept' when 2 then 'blocked' else 'other' end, ' app=', case pmod(event_id, 3) when 0 then 'https' when 1 then 'TCP' else 'smtp' end, ' spt=', pmod(event_id, 70000), ' dpt=443 in=', user_id, ' out=', pmod(event_id, 977), ' outcome=', pmod(event_id, 700), ' msg=user did ', event_type)"
    return events.select("event_id", F.expr(line).alias("message_sanitized"))


def pam(customer: DataFrame) -> DataFrame:
    line = "concat('<86>Jan  2 11:22:33 host sshd[', c_custkey, ']: ', case pmod(c_custkey, 4) when 0 then 'pam_unix(sshd:auth): authentication failure; logname=' when 1 then 'pam_unix(sshd:session): session opened for user x' when 2 then 'pam_unix(sshd:session): session closed for user x' else concat('gw Duration: ', pmod(c_custkey, 30), ':07:09 Count: ', c_custkey, '; svc: Authentication ', case when c_acctbal < 0 then 'failure' else 'success' end, '.') end)"
    return customer.select("c_custkey", F.expr(line).alias("message_sanitized"))


def audit(part: DataFrame) -> DataFrame:
    line = "concat('<86>Jan  2 11:22:33 host audispd: type=', case pmod(p_partkey, 5) when 0 then 'PATH' when 1 then 'SYSCALL' when 2 then 'CWD' when 3 then 'PROCTITLE' else 'EXECVE' end, ' msg=audit(1600000000.1:', p_partkey, '): arch=c000003e syscall=', p_size, ' success=', case when pmod(p_partkey, 2) = 0 then 'yes' else 'no' end, ' exit=', p_size - 25, ' exe=\"/bin/x y\"', case when pmod(p_partkey, 11) = 0 then ' exit=0' else '' end)"
    return part.select("p_partkey", F.expr(line).alias("message_sanitized"))


def flow(supplier: DataFrame) -> DataFrame:
    line = "concat('<134>Original Address=10.0.0.1 1 1600000000.1 fw flows ', case pmod(s_suppkey, 3) when 0 then 'allow ' when 1 then 'deny ' else '' end, 'src=10.1.1.1 dst=10.2.2.2 mac=00:11 protocol=udp sport=', s_suppkey, ' dport=53 pattern: ', case pmod(s_suppkey, 4) when 0 then '0 all' when 1 then '1 all' when 2 then 'deny dst 10.3.3.3' else 'allow dst nowhere' end)"
    return supplier.select("s_suppkey", F.expr(line).alias("message_sanitized"))


def panos(orders: DataFrame) -> DataFrame:
    line = "concat('<134>Jan 02 11:22:33 fw 1,2024/01/02 11:22:33,serial,', case when pmod(o_orderkey, 7) = 0 then 'SYSTEM' else 'TRAFFIC' end, ',end,1,2024/01/02 11:22:33,10.0.0.1,10.0.0.2,,,\"rule, one\",,,app,vsys1,trust,untrust,,,,,,,', pmod(o_orderkey, 65536), ',', pmod(o_custkey, 65536), ',,,0x19,', case pmod(o_custkey, 3) when 0 then 'tcp' when 1 then 'udp' else 'icmp' end, ',', case pmod(o_orderkey, 4) when 0 then 'allow' when 1 then 'drop' when 2 then 'reset-both' else 'alert' end, repeat(',', 16))"
    return orders.select("o_orderkey", F.expr(line).alias("message_sanitized"))


def sentence(orders: DataFrame) -> DataFrame:
    line = "concat('<134>Jan 02 2024 11:22:33: fw Deny ', case when pmod(o_custkey, 2) = 0 then 'inbound' else 'outbound' end, ' ', case when pmod(o_orderkey, 2) = 0 then 'TCP' else 'UDP' end, ' from 10.0.0.1/', pmod(o_orderkey, 65536), ' to USER-0007/', case when pmod(o_custkey, 3) = 0 then '-' else cast(pmod(o_custkey, 65536) as string) end, case when pmod(o_orderkey, 5) = 0 then ' due to DNS Response' else ' on interface outside' end)"
    return orders.select("o_orderkey", F.expr(line).alias("message_sanitized"))


def auth(events: DataFrame) -> DataFrame:
    line = "concat('{\"application\": \"app\", \"user\": {\"name\": \"u', user_id, '\"}, \"result\": \"', case pmod(event_id, 5) when 0 then 'SUCCESS' when 1 then 'denied' when 2 then 'allow' when 3 then 'fail' else 'USER-0001' end, '\", \"reason\": \"', case pmod(user_id, 4) when 0 then 'invalid_passcode' when 1 then 'valid_passcode' when 2 then 'no_response' else 'allow_unenrolled_user' end, '\", \"txid\": \"', event_id, '\"', case when pmod(event_id, 9) = 0 then ', \"txid\": \"again\"' else '' end, '}')"
    return events.select("event_id", F.expr(line).alias("message_sanitized"))


def winlog(events: DataFrame) -> DataFrame:
    line = "concat('{\"message\": \"', case pmod(event_id, 3) when 0 then 'An account failed to log on.' when 1 then 'An account was successfully logged on.' else 'A process has exited, and it said so.' end, '\\\\n\\\\nSubject: some account of some domain\", \"winlog\": {\"event_data\": {\"Status\": \"0xc000006d\", \"SubStatus\": \"', case when pmod(user_id, 2) = 0 then '0xC000006A' else '0x0' end, '\", \"LogonType\": \"', pmod(event_id, 12), '\", \"AuthenticationPackageName\": \"NTLM\"}}, \"event\": {\"code\": ', case pmod(event_id, 4) when 0 then '4624' when 1 then '4625' else '4688' end, ', \"provider\": \"Microsoft-Windows-Security-Auditing\"}}')"
    return events.select("event_id", F.expr(line).alias("message_sanitized"))


def icmp(lineitem: DataFrame) -> DataFrame:
    line = "concat('<134>Original Address=10.0.0.1 1 1600000000.1 fw l7_firewall src=10.1.1.1 dst=10.2.2.2 protocol=icmp type=', pmod(l_orderkey, 14), ' code=', pmod(l_partkey, 15), ' decision=', case when l_linenumber = 1 then 'blocked' else 'allowed' end)"
    return lineitem.select("l_orderkey", "l_linenumber", F.expr(line).alias("message_sanitized"))


def acl(orders: DataFrame) -> DataFrame:
    line = "concat('<134>Jan  2 11:22:33 fw asa: ', case pmod(o_orderkey, 3) when 0 then 'TCP' when 1 then 'UDP' else 'icmp' end, ' access denied by ACL from 10.1.2.3/', case when pmod(o_orderkey, 7) = 0 then '00' else '' end, pmod(o_custkey, 70000), ' to ', case pmod(o_custkey, 3) when 0 then 'outside' when 1 then 'dmz_2' else 'vlan9' end, ':10.9.8.7/', case when pmod(o_orderkey, 5) = 0 then 'USER-0001' else cast(pmod(o_orderkey, 65536) as string) end)"
    return orders.select("o_orderkey", F.expr(line).alias("message_sanitized"))


def protocol(lineitem: DataFrame) -> DataFrame:
    line = "concat('<134>Jan  2 11:22:33 fw Deny protocol ', pmod(l_partkey, 300), ' src ', case pmod(l_suppkey, 3) when 0 then 'inside' when 1 then 'DMZ' else 'vlan1' end, ':10.0.0.1 dst outside:10.0.0.2 by access-group \"acl\" [0x0, 0x0]', case when pmod(l_orderkey, 11) = 0 then concat(char(1), ' not a denial') else '' end)"
    return lineitem.select("l_orderkey", "l_linenumber", F.expr(line).alias("message_sanitized"))


def category(part: DataFrame) -> DataFrame:
    line = "concat('<134>Jan  2 11:22:33 fw app: [ Category = ', p_brand, ' ] [ FORMAT_MESSAGE = size ', p_size, ' ]', case when pmod(p_partkey, 6) = 0 then '[FORMAT_USER-1 = again]' else '' end)"
    return part.select("p_partkey", F.expr(line).alias("message_sanitized"))


def rendered(events: DataFrame) -> DataFrame:
    line = "concat('<Event xmlns=\"x\"><System><Provider Name=\"S\" Guid=\"{54849625-5478-4994-a5ba-3e3b0328c30d}\"/><EventID>', case pmod(event_id, 4) when 0 then '4624' when 1 then '4625' else '4688' end, '</EventID><Version>1</Version></System><RenderingInfo Culture=\"en\">', case pmod(event_id, 3) when 0 then 'An account failed to log on.' when 1 then 'An account was successfully logged on.' else 'A process has exited, and it said so.' end, '\\\\n\\\\nSubject: user ', user_id, case when pmod(event_id, 7) = 0 then '<Message>open' else '</RenderingInfo></Event>' end)"
    return events.select("event_id", F.expr(line).alias("message_sanitized"))


def bounded(events: DataFrame) -> DataFrame:
    line = "case pmod(event_id, 4) when 0 then concat('{\"message\": \"user ', user_id, ' did it\"}') when 1 then concat('{\"behaviors\": [{\"cmdline\": \"run ', event_id, '\", \"broken\": \"\\\\q\"}]') when 2 then concat('{\"behaviors\": [{\"user\": ', user_id, '}]}') else concat('{\"other\": {\"message\": \"', event_type, '\"}}') end"
    return events.select("event_id", "user_id", F.expr(line).alias("message_sanitized"))


def registered(orders: DataFrame) -> DataFrame:
    """Denials as the sequence model reads them, some of which it can't: another header, a long name, another event."""
    line = "concat('<166>Jan 02 USER-0021 11:22:33: ', case when pmod(o_orderkey, 10) = 3 then '%ASA-4-106023:' else 'USER-0010-0324' end, ' Deny ', case when pmod(o_orderkey, 10) = 4 then 'gre' else 'tcp' end, ' src outside:10.1.2.3/', pmod(o_orderkey, 65536), ' dst inside:10.9.8.7/', pmod(o_custkey, 65536), ' by access-group \"', case when pmod(o_orderkey, 10) = 5 then repeat('a', 150) else 'acl' end, '\" [0x0, 0x0]')"
    port = "case pmod(o_orderkey, 4) when 0 then cast(pmod(o_orderkey, 65536) as string) when 1 then concat('00', pmod(o_custkey, 65536)) when 2 then ' 1' end"
    return orders.select(F.col("o_orderkey").cast("string").alias("event_id"), F.expr(line).alias("message_sanitized"), F.expr(port).alias("src_port"))
