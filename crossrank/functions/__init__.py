"""Column expressions: everything here stays inside the JVM unless the name says otherwise."""
