"""tabulon: table-question analytics and corpus preparation as Spark plans."""
