"""Analytics over bank-account transactions, Spark first."""
