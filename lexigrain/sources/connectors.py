"""Readers of relational databases by driver name, through JDBC, and of folders of files."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Options that every JDBC reader has unless the configuration says otherwise.
DEFAULTS = {"fetchsize": "10000"}


def jdbc_options(config: Mapping, defaults: Mapping[str, str] = DEFAULTS) -> dict[str, str]:
    """Defaults, overridden by the configuration's own ``options``."""
    return {**defaults, **{str(k): str(v) for k, v in (config.get("options") or {}).items()}}


def _host(config: Mapping, port: int) -> str:
    return f"{config.get('host') or 'localhost'}:{config.get('port') or port}"


def _login(config: Mapping) -> dict[str, str]:
    return {k: str(config[c]) for k, c in (("user", "username"), ("password", "password")) if config.get(c) is not None}


def _mysql(config: Mapping) -> dict[str, str]:
    statements = []
    if charset := config.get("charset"):
        statements.append(f"SET NAMES '{charset}' COLLATE '{config.get('collation') or 'utf8_unicode_ci'}'")
    if zone := config.get("timezone"):
        statements.append(f"SET time_zone = '{zone}'")
    if (modes := config.get("modes")) is not None:
        statements.append(f"SET SESSION sql_mode = '{','.join(modes)}'")
    elif config.get("strict") is not None:
        strict = "STRICT_ALL_TABLES,ONLY_FULL_GROUP_BY" if config["strict"] else ""
        statements.append(f"SET SESSION sql_mode = '{','.join(filter(None, (strict, 'NO_ENGINE_SUBSTITUTION')))}'")
    url = f"jdbc:mysql://{_host(config, 3306)}/{config['database']}?useCursorFetch=true"
    if socket := config.get("unix_socket"):
        url += f"&localSocket={socket}"
    return {"url": url, "driver": "com.mysql.cj.jdbc.Driver"} | _session(statements)


def _postgres(config: Mapping) -> dict[str, str]:
    statements = [f"SET client_encoding TO '{config.get('charset') or 'utf8'}'"]
    if zone := config.get("timezone"):
        statements.append(f"SET TIME ZONE '{zone}'")
    if schema := config.get("schema"):
        names = [schema] if isinstance(schema, str) else schema
        statements.append("SET search_path TO " + ", ".join(f'"{n}"' for n in names))
    url = f"jdbc:postgresql://{_host(config, 5432)}/{config['database']}"
    extra = [f"{k}={v}" for k, v in (("sslmode", config.get("sslmode")), ("ApplicationName", config.get("application_name"))) if v]
    return {"url": url + ("?" + "&".join(extra) if extra else ""), "driver": "org.postgresql.Driver"} | _session(statements)


def _sqlite(config: Mapping) -> dict[str, str]:
    database = config["database"]
    if database != ":memory:" and not os.path.exists(database):
        raise FileNotFoundError(f"database {database} doesn't exist")
    return {"url": f"jdbc:sqlite:{database if database == ':memory:' else os.path.realpath(database)}", "driver": "org.sqlite.JDBC"}


def _sqlserver(config: Mapping) -> dict[str, str]:
    name = f";databaseName={config['database']}" if config.get("database") else ""
    return {"url": f"jdbc:sqlserver://{_host(config, 1433)}{name}", "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver"}


def _oracle(config: Mapping) -> dict[str, str]:
    return {"url": f"jdbc:oracle:thin:@{config.get('dbtns') or _host(config, 1521) + '/' + str(config['database'])}", "driver": "oracle.jdbc.OracleDriver"}


def _derby(config: Mapping) -> dict[str, str]:
    """The embedded database that comes with Spark."""
    return {"url": f"jdbc:derby:{config['database']}", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _session(statements: list[str]) -> dict[str, str]:
    return {"sessionInitStatement": "; ".join(statements)} if statements else {}


_DRIVERS = {"mysql": _mysql, "mariadb": _mysql, "pgsql": _postgres, "sqlite": _sqlite, "sqlsrv": _sqlserver, "oracledb": _oracle, "derby": _derby}


def connection(config: Mapping) -> dict[str, str] | None:
    """Reader options for a configuration with its ``driver``; none for a folder of files."""
    if not config.get("driver"):
        raise ValueError("the configuration names no driver")
    if config["driver"] == "filesystem":
        return None
    if config["driver"] not in _DRIVERS:
        raise ValueError(f"unknown driver: {config['driver']}")
    return jdbc_options(config) | _DRIVERS[config["driver"]](config) | _login(config)


def read_query(spark: SparkSession, query: str, config: Mapping | None = None) -> DataFrame:
    """Rows of a query: of the session's own tables without a configuration, else of the database that it names.

    Where the configuration has ``partition_column``, ``lower``, ``upper`` and
    ``partitions``, that many tasks read side by side.
    """
    if config is None:
        return spark.sql(query.rstrip().rstrip(";"))
    reader = spark.read.format("jdbc").options(**connection(config))
    if column := config.get("partition_column"):
        split = {"partitionColumn": column, "lowerBound": str(config["lower"]), "upperBound": str(config["upper"]), "numPartitions": str(config["partitions"])}
        return reader.options(**split).option("dbtable", f"({query.rstrip().rstrip(';')}) source").load()
    return reader.option("query", query.rstrip().rstrip(";")).load()
