"""Column builders: no function here touches data by itself, so Catalyst sees plain expressions."""
