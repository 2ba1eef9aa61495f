"""Column-expression helpers; everything here stays inside the JVM."""
