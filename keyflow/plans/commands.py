"""What is known of each command: arity, flags and key positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE = "name string, arity int, flags array<string>, first_key int, last_key int, step int, runs boolean"

# Fixed values of the commands that run: name, number of arguments with the name (negative: at least), flags, and the first key,
# last key and step among the arguments.
RUN = """
PING -1 fast 0,0,0
ECHO 2 fast 0,0,0
QUIT 1 fast 0,0,0
SELECT 2 fast 0,0,0
COMMAND -1 slow 0,0,0
INFO -1 slow 0,0,0
DBSIZE 1 read+fast 0,0,0
FLUSHDB -1 write+slow 0,0,0
FLUSHALL -1 write+slow 0,0,0
TIME 1 read+fast 0,0,0
MULTI 1 fast 0,0,0
EXEC 1 slow 0,0,0
DISCARD 1 fast 0,0,0
WATCH -2 fast 1,-1,1
UNWATCH 1 fast 0,0,0
TYPE 2 read+fast 1,1,1
SCAN -2 read+slow 0,0,0
RANDOMKEY 1 read 0,0,0
KEYS 2 read+slow 0,0,0
COPY -3 write 1,2,1
SET -3 write 1,1,1
SETNX 3 write+fast 1,1,1
SETEX 4 write 1,1,1
PSETEX 4 write 1,1,1
MSET -3 write 1,-1,2
MSETNX -3 write 1,-1,2
GET 2 read+fast 1,1,1
GETDEL 2 write+fast 1,1,1
GETEX -2 write+fast 1,1,1
GETRANGE 4 read 1,1,1
SETRANGE 4 write 1,1,1
MGET -2 read+fast 1,-1,1
GETSET 3 write 1,1,1
INCR 2 write+fast 1,1,1
INCRBY 3 write+fast 1,1,1
INCRBYFLOAT 3 write+fast 1,1,1
DECR 2 write+fast 1,1,1
DECRBY 3 write+fast 1,1,1
APPEND 3 write 1,1,1
STRLEN 2 read+fast 1,1,1
DEL -2 write 1,-1,1
UNLINK -2 write+fast 1,-1,1
EXISTS -2 read+fast 1,-1,1
EXPIRE 3 write+fast 1,1,1
EXPIREAT 3 write+fast 1,1,1
EXPIRETIME 2 read+fast 1,1,1
PEXPIRE 3 write+fast 1,1,1
PEXPIREAT 3 write+fast 1,1,1
PEXPIRETIME 2 read+fast 1,1,1
PERSIST 2 write+fast 1,1,1
TTL 2 read+fast 1,1,1
PTTL 2 read+fast 1,1,1
RENAME 3 write 1,2,1
RENAMENX 3 write 1,2,1
TOUCH -2 read+fast 1,-1,1
"""

# Fixed values of the commands that are known by name only, and answer that they aren't implemented.
KNOWN = """
AUTH -2 fast 0,0,0
HELLO -1 fast 0,0,0
RESET 1 fast 0,0,0
CLIENT -2 slow 0,0,0
CONFIG -2 admin+slow 0,0,0
DEBUG -2 admin+slow 0,0,0
SAVE 1 admin+slow 0,0,0
BGSAVE -1 admin 0,0,0
BGREWRITEAOF 1 admin 0,0,0
LASTSAVE 1 read+fast 0,0,0
SLOWLOG -2 admin 0,0,0
WAIT 3 slow+blocking 0,0,0
SHUTDOWN -1 admin+slow 0,0,0
SWAPDB 3 write+slow 0,0,0
OBJECT -2 read+slow 2,2,1
DUMP 2 read 1,1,1
RESTORE -4 write 1,1,1
SUBSTR 4 read 1,1,1
LCS -3 read 1,2,1
SORT -2 write+slow 1,1,1
SORT_RO -2 read+slow 1,1,1
LPUSH -3 write+fast 1,1,1
RPUSH -3 write+fast 1,1,1
LPUSHX -3 write+fast 1,1,1
RPUSHX -3 write+fast 1,1,1
LPOP -2 write+fast 1,1,1
RPOP -2 write+fast 1,1,1
LLEN 2 read+fast 1,1,1
LINDEX 3 read 1,1,1
LINSERT 5 write 1,1,1
LSET 4 write 1,1,1
LRANGE 4 read 1,1,1
LTRIM 4 write 1,1,1
LREM 4 write 1,1,1
LPOS -3 read 1,1,1
LMOVE 5 write 1,2,1
LMPOP -4 write 1,-1,1
BLPOP -3 write+blocking 1,-1,1
BRPOP -3 write+blocking 1,-1,1
BLMOVE 6 write+blocking 1,2,1
BLMPOP -5 write+blocking 2,-1,1
HSET -4 write+fast 1,1,1
HGET 3 read+fast 1,1,1
HSETNX 4 write+fast 1,1,1
HMSET -4 write+fast 1,1,1
HMGET -3 read+fast 1,1,1
HDEL -3 write+fast 1,1,1
HEXISTS 3 read+fast 1,1,1
HLEN 2 read+fast 1,1,1
HKEYS 2 read+slow 1,1,1
HVALS 2 read+slow 1,1,1
HGETALL 2 read+slow 1,1,1
HINCRBY 4 write+fast 1,1,1
HINCRBYFLOAT 4 write+fast 1,1,1
HRANDFIELD -2 read 1,1,1
HSCAN -3 read+slow 1,1,1
SADD -3 write+fast 1,1,1
SREM -3 write+fast 1,1,1
SISMEMBER 3 read+fast 1,1,1
SMISMEMBER -3 read+fast 1,1,1
SMEMBERS 2 read+slow 1,1,1
SCARD 2 read+fast 1,1,1
SPOP -2 write+fast 1,1,1
SRANDMEMBER -2 read 1,1,1
SINTER -2 read+slow 1,-1,1
SINTERCARD -3 read+slow 2,-1,1
SINTERSTORE -3 write+slow 1,-1,1
SUNION -2 read+slow 1,-1,1
SUNIONSTORE -3 write+slow 1,-1,1
SDIFF -2 read+slow 1,-1,1
SDIFFSTORE -3 write+slow 1,-1,1
SMOVE 4 write+fast 1,2,1
SSCAN -3 read+slow 1,1,1
ZADD -4 write+fast 1,1,1
ZREM -3 write+fast 1,1,1
ZSCORE 3 read+fast 1,1,1
ZMSCORE -3 read+fast 1,1,1
ZINCRBY 4 write+fast 1,1,1
ZCARD 2 read+fast 1,1,1
ZCOUNT 4 read+fast 1,1,1
ZLEXCOUNT 4 read+fast 1,1,1
ZRANGE -4 read 1,1,1
ZRANGESTORE -5 write 1,2,1
ZRANGEBYLEX -4 read 1,1,1
ZRANGEBYSCORE -4 read 1,1,1
ZREVRANGE 4 read 1,1,1
ZREVRANGEBYLEX -4 read 1,1,1
ZREVRANGEBYSCORE -4 read 1,1,1
ZREVRANK 3 read+fast 1,1,1
ZRANK 3 read+fast 1,1,1
ZRANDMEMBER -2 read 1,1,1
ZPOPMIN -2 write+fast 1,1,1
ZPOPMAX -2 write+fast 1,1,1
BZPOPMIN -3 write+blocking 1,-1,1
BZPOPMAX -3 write+blocking 1,-1,1
ZINTERSTORE -4 write+slow 1,1,1
ZUNIONSTORE -4 write+slow 1,1,1
ZDIFFSTORE -4 write+slow 1,1,1
ZINTER -3 read+slow 1,-1,1
ZUNION -3 read+slow 1,-1,1
ZDIFF -3 read+slow 1,-1,1
ZINTERCARD -3 read+slow 2,-1,1
ZSCAN -3 read+slow 1,1,1
ZMPOP -4 write 2,-1,1
BZMPOP -5 write+blocking 3,-1,1
SUBSCRIBE -2 pubsub+slow 0,0,0
UNSUBSCRIBE -1 pubsub+slow 0,0,0
PSUBSCRIBE -2 pubsub+slow 0,0,0
PUNSUBSCRIBE -1 pubsub+slow 0,0,0
PUBLISH 3 pubsub+fast 0,0,0
PUBSUB -2 pubsub+slow 0,0,0
EVAL -3 scripting+slow 0,0,0
EVALSHA -3 scripting+slow 0,0,0
EVALRO -3 scripting+slow 0,0,0
EVALSHA_RO -3 scripting+slow 0,0,0
SCRIPT -2 scripting+slow 0,0,0
PFADD -2 write+fast 1,1,1
PFCOUNT -2 read+slow 1,-1,1
PFMERGE -2 write+slow 1,-1,1
SETBIT 4 write 1,1,1
GETBIT 3 read+fast 1,1,1
BITCOUNT -2 read 1,1,1
BITOP -4 write+slow 2,-1,1
BITPOS -3 read 1,1,1
BITFIELD -2 write 1,1,1
BITFIELD_RO -2 read+fast 1,1,1
GEOADD -5 write 1,1,1
GEODIST -4 read 1,1,1
GEOHASH -3 read 1,1,1
GEOPOS -3 read 1,1,1
GEORADIUS -6 write+slow 1,1,1
GEORADIUS_RO -6 read+slow 1,1,1
GEORADIUSBYMEMBER -5 write+slow 1,1,1
GEORADIUSBYMEMBER_RO -5 read+slow 1,1,1
GEOSEARCH -7 read 1,1,1
GEOSEARCHSTORE -8 write 1,2,1
XADD -5 write+fast 1,1,1
XLEN 2 read+fast 1,1,1
XRANGE -4 read 1,1,1
XREVRANGE -4 read 1,1,1
XREAD -4 read+slow 0,0,0
XREADGROUP -7 write+slow 0,0,0
XACK -4 write+fast 1,1,1
XCLAIM -6 write 1,1,1
XAUTOCLAIM -7 write 1,1,1
XDEL -3 write+fast 1,1,1
XTRIM -4 write 1,1,1
XINFO -2 read+slow 2,2,1
XGROUP -2 write+slow 2,2,1
XPENDING -3 read 1,1,1
XSETID 3 write 1,1,1
CLUSTER -2 admin 0,0,0
ASKING 1 fast 0,0,0
READONLY 1 fast 0,0,0
READWRITE 1 fast 0,0,0
"""

# Known commands that COMMAND leaves out, and one that it counts twice.
UNLISTED = ("SMOVE", "ZMPOP", "BZMPOP")
TWICE = ("WAIT",)


def _rows(text: str, runs: bool) -> dict[str, tuple]:
    rows = {}
    for line in text.split("\n")[1:-1]:
        name, arity, flags, keys = line.split(" ")
        rows[name] = (name, int(arity), flags.split("+"), *map(int, keys.split(",")), runs)
    return rows


COMMANDS: dict[str, tuple] = _rows(RUN, True) | _rows(KNOWN, False)


def command_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*COMMANDS.values()], TABLE)


def listed() -> list[str]:
    return [n for n in COMMANDS if n not in UNLISTED] + [*TWICE]


def arity_fits(name: str, arguments: int) -> bool:
    """Whether a known command takes this many arguments, its name included."""
    arity = COMMANDS[name][1]
    return arguments == arity if arity >= 0 else arguments >= -arity
