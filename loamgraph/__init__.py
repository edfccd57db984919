"""loamgraph: source-code intelligence over many repositories, as Spark plans."""
