"""Sequential kernels on arrays: no Spark here. They run inside one task on a model of bounded size, or on a whole small graph."""
