"""Tables, declarative intake, the semantic layer and the provenance ledger."""
