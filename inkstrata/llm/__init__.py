"""Training-data operators: each module holds one operator, `queries` wires them up."""
