"""docweave: document retrieval and question answering operators as Spark plans."""
