"""Endpoint health over streams, with batch twins."""

# State store that transformWithState needs.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
