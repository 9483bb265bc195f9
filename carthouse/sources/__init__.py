"""Sources and sinks: journal scans and codecs, keyed read-side tables,
snapshots, the purchase-record frame and the JDBC statement builder."""
