"""Run a Spark result against comparison SQL and show the first differences."""


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value)


def differences(df, connection, sql, show=3):
    """(Spark rows, SQL rows, rows only in Spark, rows only in SQL)."""
    from collections import Counter
    columns = sorted(df.columns)
    spark_rows = [tuple(normal(r[c]) for c in columns) for r in df.select(*columns).collect()]
    cursor = connection.cursor()
    cursor.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns] if sorted(names) == columns else None
    if order is None:
        raise AssertionError(f"columns differ: {sorted(names)} and {columns}")
    sql_rows = [tuple(normal(r[i]) for i in order) for r in cursor.fetchall()]
    left, right = Counter(spark_rows), Counter(sql_rows)
    return (len(spark_rows), len(sql_rows), list((left - right).elements())[:show],
            list((right - left).elements())[:show])
