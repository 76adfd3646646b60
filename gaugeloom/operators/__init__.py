"""DataFrame to DataFrame operators.  Ids, orders and texts are columns; nothing is collected to the driver."""
