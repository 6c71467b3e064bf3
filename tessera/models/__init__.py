"""Models as operators: a registry, native and ONNX operators."""
