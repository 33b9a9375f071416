"""Column expressions: values, periods, context, labels and names."""
