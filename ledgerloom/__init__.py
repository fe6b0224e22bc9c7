"""Analytics over relational archives, table rows, file inventories and ledgers, as Spark DataFrame operators."""
